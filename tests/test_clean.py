import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from boreflow.operators import clean as C

D0 = dt.date(2024, 1, 1)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "well string, ds date, a string, b string")


def test_null_blanks_zeros(spark):
    df = _frame(spark, [("w", D0, "", "0"), ("w", D0 + dt.timedelta(1), "2.5", None), ("w", D0 + dt.timedelta(2), "x", "3")])
    out = C.null_blanks_zeros(df, ["a", "b"]).orderBy("ds").collect()
    assert [r.a for r in out] == [None, 2.5, None]
    assert [r.b for r in out] == [None, None, 3.0]


def test_interpolate_matches_pandas_by_position(spark):
    rng = np.random.default_rng(0)
    rows = []
    for w in ("p", "q"):
        vals = rng.normal(10, 3, 60)
        vals[[0, 1, 5, 6, 7, 20, 58, 59]] = np.nan  # leading, interior run, trailing gaps
        # unsorted input dates: the operator must order by ds itself
        for i in rng.permutation(60):
            rows.append((w, D0 + dt.timedelta(int(i) * 2), None if np.isnan(vals[i]) else float(vals[i])))
    df = spark.createDataFrame(rows, "well string, ds date, v double")
    got = C.interpolate(df, ["v"]).toPandas().sort_values(["well", "ds"]).reset_index(drop=True)
    exp = pd.DataFrame(rows, columns=["well", "ds", "v"]).sort_values(["well", "ds"]).reset_index(drop=True)
    exp["v"] = exp.groupby("well")["v"].transform(lambda s: s.reset_index(drop=True).interpolate(limit_direction="both").values)
    assert np.isfinite(got["v"]).all()
    np.testing.assert_allclose(got["v"].to_numpy(), exp["v"].to_numpy(), rtol=0, atol=1e-12)


def test_interpolate_all_null_column_stays_null(spark):
    df = spark.createDataFrame([("w", D0, None), ("w", D0 + dt.timedelta(1), None)], "well string, ds date, v double")
    assert [r.v for r in C.interpolate(df, ["v"]).collect()] == [None, None]


def test_fill_median_and_drop(spark):
    df = spark.createDataFrame([("w", D0 + dt.timedelta(i), v) for i, v in enumerate([1.0, None, 3.0, 10.0, None])],
                               "well string, ds date, v double")
    got = sorted(r.v for r in C.fill_median(df, ["v"]).collect())
    assert got == [1.0, 3.0, 3.0, 3.0, 10.0]
    assert C.drop_nulls(df, ["v"]).count() == 3


def test_ffill_and_time_index(spark):
    df = spark.createDataFrame([("w", D0 + dt.timedelta(i), v) for i, v in enumerate([None, 2.0, None, None, 5.0])],
                               "well string, ds date, v double")
    got = C.time_index(C.ffill(df, ["v"])).orderBy("ds").collect()
    assert [r.v for r in got] == [None, 2.0, 2.0, 2.0, 5.0]
    assert [r.time_idx for r in got] == [0, 1, 2, 3, 4]
    assert got[0].well_id == "w"


def test_missing_profile(spark):
    df = _frame(spark, [("w", D0, "", "0"), ("w", D0 + dt.timedelta(1), "1", "0")])
    prof = {(r.param): r for r in C.missing_profile(df, ["a", "b"]).collect()}
    assert prof["a"].nulls == 1 and prof["a"].zeros == 0 and prof["a"].pct_null == 50.0
    assert prof["b"].zeros == 2 and prof["b"].pct_zero == 100.0


def test_clean_chain_has_no_nulls(spark):
    from tests.conftest import SF
    from boreflow.sources import testpanel as T

    out = C.clean(T.main_panel(spark, SF), T.PARAMS, target=T.TARGET)
    assert out.filter(" OR ".join(f"{p} IS NULL" for p in T.PARAMS)).count() == 0
    assert out.filter(F.col("qty") == 0).count() == 0
