import datetime as dt
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from boreflow.operators import evaluate as E
from boreflow.sources import history as HI
from boreflow.sources import sheets as S


def test_read_sheets_csv(spark):
    d = tempfile.mkdtemp(prefix="sheets-", dir="/tmp")
    with open(os.path.join(d, "rate.csv"), "w") as f:
        f.write("date,W1,W2\n2024-01-02,1.5,\n2024-01-01,0,2\n2024-01-03,x,3\n")
    with open(os.path.join(d, "press.csv"), "w") as f:
        f.write("date,W1\n2024-01-01,7\n2024-01-04,8\n")
    long = S.read_sheets(spark, {"rate": f"{d}/rate.csv", "press": f"{d}/press.csv"})
    got = {(r.param, r.well, str(r.ds)): r.value for r in long.collect()}
    assert got[("rate", "W1", "2024-01-02")] == 1.5
    assert got[("rate", "W2", "2024-01-02")] is None and got[("rate", "W1", "2024-01-03")] is None
    panel = S.to_panel(long, ["rate", "press"])
    assert panel.filter("well = 'W1'").count() == 4  # outer union of both sheets' dates
    assert S.to_panel(long, ["rate", "press"]).filter("well = 'W2'").select("press").distinct().collect()[0][0] is None
    cat = {(r.param, r.well): r.n_days for r in S.catalog(long).collect()}
    assert cat == {("rate", "W1"): 3, ("rate", "W2"): 3, ("press", "W1"): 2}


def test_history_roundtrip(spark):
    path = tempfile.mkdtemp(prefix="hist-", dir="/tmp") + "/h"
    d0 = dt.date(2024, 1, 1)
    rows = [("w", "ETS", {"alpha": a}, f, "test", d0, 1, 10.0, 10.0 - f, None, None) for f in range(5) for a in ("0.3",)]
    fc = spark.createDataFrame(rows, "well string, model string, params map<string,string>, fold int, part string, ds date, step int, "
                                     "y double, yhat double, yhat_lower double, yhat_upper double")
    HI.append_history(fc, path, "qty", 30, "interpolate", "2024-01-01 00:00:00")
    HI.append_history(fc, path, "qty", 7, "median", "2024-01-02 00:00:00")
    h = HI.read_history(spark, path).collect()
    assert [r.horizon for r in h] == [30, 7]
    assert h[0].rmse == 4.0 and h[0].mape == 40.0 and h[0].params == {"alpha": "0.3"}
    assert HI.read_history(spark, path, "ETS").count() == 2
    assert HI.read_forecasts(spark, path).count() == 10


def test_history_names_the_parameters_used(spark):
    from boreflow.plans import forecast as FC

    df = spark.createDataFrame([("w", dt.date(2024, 1, 1) + dt.timedelta(i), 5.0 + i % 4) for i in range(60)], "well string, ds date, y double")
    fc = FC.forecast(df, "y", "ETS", horizon=3, params={"alpha": 0.3, "gamma": 0.1, "n_bootstrap_draws": 10})
    path = tempfile.mkdtemp(prefix="hist-", dir="/tmp") + "/h"
    HI.append_history(fc, path, "y", 3, "none")
    used = {tuple(sorted(r.params.items())) for r in fc.collect()}
    assert {tuple(sorted(r.params.items())) for r in HI.read_history(spark, path).collect()} == used and len(used) == 1
    assert dict(next(iter(used)))["n_bootstrap_draws"] == "10"
    # fitted weights differ by training part: the history names those of the last fold, which it logs
    fitted = FC.forecast(df, "y", "ETS", horizon=3, params={"n_bootstrap_draws": 0})
    path = tempfile.mkdtemp(prefix="hist-", dir="/tmp") + "/h"
    HI.append_history(fitted, path, "y", 3, "none")
    assert [r.params for r in HI.read_history(spark, path).collect()] == [fitted.filter("fold = 4").first().params]


def _small_forecast(spark, yhat):
    rows = [(w, m, {"a": "1"}, f, "test", dt.date(2024, 1, 1 + f), 1, 10.0, yhat, None, None) for w in "uv" for m in ("ETS", "DLT") for f in range(3)]
    return spark.createDataFrame(rows, "well string, model string, params map<string,string>, fold int, part string, ds date, step int, "
                                       "y double, yhat double, yhat_lower double, yhat_upper double")


@pytest.mark.parametrize("broken", [0, 1, 2])
def test_a_run_that_breaks_off_is_not_seen_and_a_retry_is_whole(spark, monkeypatch, broken):
    path = tempfile.mkdtemp(prefix="hist-", dir="/tmp") + "/h"
    HI.append_history(_small_forecast(spark, 9.0), path, "y", 3, "none", "2024-01-01 00:00:00", "first")
    write, calls = HI._replace, []

    def fails(df, where, by):
        calls.append(where)
        if len(calls) == broken + 1:
            raise OSError("the executor is gone")
        write(df, where, by)

    monkeypatch.setattr(HI, "_replace", fails)
    with pytest.raises(OSError, match="gone"):
        HI.append_history(_small_forecast(spark, 8.0), path, "y", 3, "none", "2024-01-02 00:00:00", "1e5")
    monkeypatch.undo()
    assert HI.read_history(spark, path).count() == 4 and HI.read_forecasts(spark, path).count() == 12
    assert [r.run_id for r in HI.read_commits(spark, path).collect()] == ["first"]
    for _ in range(2):  # the retry, and once more: neither doubles anything
        HI.append_history(_small_forecast(spark, 7.0), path, "y", 3, "none", "2024-01-02 00:00:00", "1e5")
        h = HI.read_history(spark, path).collect()
        assert sorted(r.rmse for r in h) == [1.0] * 4 + [3.0] * 4
        assert sorted(r.yhat for r in HI.read_forecasts(spark, path, "ETS").collect()) == [7.0] * 6 + [9.0] * 6
    assert {r.run_id for r in HI.read_commits(spark, path).collect()} == {"first", "1e5"}


def test_the_forecast_is_computed_once(spark):
    path = tempfile.mkdtemp(prefix="hist-", dir="/tmp") + "/h"
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    fc = _small_forecast(spark, 9.0).repartition(2).withColumn("yhat", counted("yhat"))
    run = HI.append_history(fc, path, "y", 3, "none")
    assert seen.value == 12 and [r.run_id for r in HI.read_commits(spark, path).collect()] == [run]


def test_best_params_defaults(spark):
    t = spark.createDataFrame([("w", {"a": "1"}), ("v", None)], "well string, params map<string,string>")
    got = {r.well: r.params for r in E.best_params(t, {"a": "0", "b": "2"}).collect()}
    assert got == {"w": {"b": "2", "a": "1"}, "v": {"a": "0", "b": "2"}}


def test_daily_and_hourly_grid(spark):
    from boreflow.sources.testpanel import daily_grid

    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", d0, 1.0), ("a", d0 + dt.timedelta(3), 4.0), ("b", d0 + dt.timedelta(1), 2.0)],
                               "well string, ds date, v double")
    got = sorted((r.well, r.ds, r.v) for r in daily_grid(df).collect())
    assert got == [("a", d0, 1.0), ("a", d0 + dt.timedelta(1), None), ("a", d0 + dt.timedelta(2), None),
                   ("a", d0 + dt.timedelta(3), 4.0), ("b", d0 + dt.timedelta(1), 2.0)]
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    hf = spark.createDataFrame([("e", t0, 1.0), ("e", t0 + dt.timedelta(hours=3), 2.0)], "well string, ds timestamp, v double")
    hours = sorted(r.ds for r in daily_grid(hf, step="1 HOUR").collect())
    assert hours == [t0 + dt.timedelta(hours=h) for h in range(4)]


def test_main_panel_grid_is_complete(spark):
    from tests.conftest import SF
    from boreflow.sources import testpanel as T

    p = T.main_panel(spark, SF)
    spans = p.groupBy("well").agg(F.count("*").alias("n"), F.datediff(F.max("ds"), F.min("ds")).alias("d")).collect()
    assert all(r.n == r.d + 1 for r in spans)  # one row per calendar day, first to last
