"""Edge cases from the test strategy: constant regressor, n < 6, duplicate dates, all-null parameter."""

import datetime as dt
import math

import pytest

from pyspark.sql import functions as F

from boreflow.operators import clean as C
from boreflow.operators import screen as S
from boreflow.operators.backtest import backtest_rows, last_value_forecast
from boreflow.plans import forecast as FC
from boreflow.sources import sheets as SH

D0 = dt.date(2024, 1, 1)


def test_constant_regressor_is_not_kept(spark):
    rows = [("w", D0 + dt.timedelta(i), float(i % 5) + i * 0.1, 3.0, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "well string, ds date, y double, c double, x double")
    out = {r.regressor: r for r in S.screen(df, "y", ["c", "x"]).collect()}
    assert out["c"].r is None and not out["c"].keep_corr and not out["c"].significant
    assert out["x"].keep_corr


def test_short_series_has_no_test_rows_but_a_future(spark):
    df = spark.createDataFrame([("w", D0 + dt.timedelta(i), float(i + 1)) for i in range(5)], "well string, ds date, y double")
    rows = backtest_rows(df, "y", [], 5, horizon=2)
    assert rows.filter("part = 'test'").count() == 0  # n div 6 = 0: empty test folds
    fut = sorted((r.step, r.yhat) for r in last_value_forecast(rows).filter("part = 'future'").collect())
    assert fut == [(1, 5.0), (2, 5.0)]
    fc = FC.forecast(df, "y", "ETS", horizon=2).filter("part = 'future'").collect()
    assert len(fc) == 2 and all(math.isfinite(r.yhat) for r in fc)


def test_duplicate_dates_in_a_sheet_are_averaged(spark):
    sheet = spark.createDataFrame([("2024-01-01", "1"), ("2024-01-01", "3"), ("2024-01-02", "5")], "date string, W string")
    long = SH.read_sheets(spark, {"rate": sheet})
    panel = {str(r.ds): r.rate for r in SH.to_panel(long, ["rate"]).collect()}
    assert panel == {"2024-01-01": 2.0, "2024-01-02": 5.0}


def test_well_without_a_parameter_keeps_its_rows(spark):
    """FIXTURES 1: a well missing from one sheet; only a well without any target is dropped, and reported."""
    rows = [("w", D0 + dt.timedelta(i), float(i + 1), None) for i in range(10)]
    rows += [("v", D0 + dt.timedelta(i), None, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "well string, ds date, y double, z double")
    out = C.clean(df, ["y", "z"], target="y")
    assert {r.well for r in out.collect()} == {"w"} and out.count() == 10
    assert [(r.well, r.n_days) for r in C.dropped_wells(df, out).collect()] == [("v", 10)]
    prof = {(r.well, r.param): r for r in C.missing_profile(df, ["y", "z"]).collect()}
    assert prof["w", "z"].pct_null == 100.0 and prof["w", "y"].nulls == 0


def _awkward_panel(spark):
    """Wells of 1, 10 and 80 days, a negative one and one that lacks the regressor."""
    day = lambda i: D0 + dt.timedelta(i)
    rows = [("one", day(0), 5.0, 1.0)]
    rows += [("ten", day(i), 5.0 + i, 1.0 + i % 3) for i in range(10)]
    rows += [("long", day(i), 20.0 + i % 7, 2.0 + i % 5) for i in range(80)]
    rows += [("negative", day(i), -50.0 + i % 7, 2.0 + i % 5) for i in range(80)]
    rows += [("lacks", day(i), 9.0 + i % 7, None) for i in range(80)]
    return C.clean(spark.createDataFrame(rows, "well string, ds date, y double, z double"), ["y", "z"], target="y")


@pytest.mark.parametrize("model", FC.MODELS)
def test_every_well_gets_its_whole_horizon(spark, model):
    fc = FC.forecast(_awkward_panel(spark), "y", model, ["z"], horizon=6).filter("part = 'future'").collect()
    assert sorted((r.well, r.step) for r in fc) == sorted((w, s) for w in ("one", "ten", "long", "negative", "lacks") for s in range(1, 7))
    assert all(r.yhat is not None and math.isfinite(r.yhat) for r in fc)
    level = {"negative": (-80, -20)}
    assert all(level[r.well][0] < r.yhat < level[r.well][1] for r in fc if r.well in level)


def test_multiplicative_takes_values_of_any_sign(spark):
    fc = FC.forecast(_awkward_panel(spark), "y", "Prophet", horizon=3, params={"seasonality_mode": "multiplicative"}).filter("part = 'future'").collect()
    assert len(fc) == 15 and all(math.isfinite(r.yhat) and r.yhat_lower <= r.yhat <= r.yhat_upper for r in fc)
    assert all(-60 < r.yhat < -40 for r in fc if r.well == "negative")


def test_sheet_dates_in_another_format_fail_or_are_named(spark):
    sheet = spark.createDataFrame([("31/01/2024", "1")], "date string, W string")
    with pytest.raises(Exception, match="31/01/2024"):
        SH.read_sheets(spark, {"rate": sheet}).collect()
    assert str(SH.read_sheets(spark, {"rate": sheet}, date_format="dd/MM/yyyy").collect()[0].ds) == "2024-01-31"


def test_gap_days_become_nulls_then_interpolate(spark):
    from boreflow.sources.testpanel import daily_grid

    df = spark.createDataFrame([("w", D0, 1.0), ("w", D0 + dt.timedelta(4), 5.0)], "well string, ds date, v double")
    out = [r.v for r in C.interpolate(daily_grid(df), ["v"]).orderBy("ds").collect()]
    assert out == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert daily_grid(df).filter(F.col("v").isNull()).count() == 3
