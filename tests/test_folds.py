import datetime as dt

from boreflow.operators import folds as B
from boreflow.operators.backtest import backtest_rows, last_value_forecast

D0 = dt.date(2024, 1, 1)


def _series(spark, n, well="w"):
    return spark.createDataFrame([(well, D0 + dt.timedelta(i), float(i)) for i in range(n)], "well string, ds date, y double")


def test_expanding_folds_formula(spark):
    n = 40
    out = B.expanding_folds(_series(spark, n), 5).collect()
    s = n // 6
    for k in range(5):
        tr = [r.pos for r in out if r.fold == k and r.part == "train"]
        te = [r.pos for r in out if r.fold == k and r.part == "test"]
        assert sorted(tr) == list(range(n - (5 - k) * s))
        assert sorted(te) == list(range(n - (5 - k) * s, n - (5 - k) * s + s))


def test_holdout(spark):
    out = B.holdout(_series(spark, 100), 0.7, 0.95).collect()
    assert sorted(r.pos for r in out if r.part == "train") == list(range(70))
    assert sorted(r.pos for r in out if r.part == "test") == list(range(95, 100))


def test_backtest_rows_and_baseline(spark):
    df = _series(spark, 30)
    rows = backtest_rows(df, "y", [], 5, horizon=3)
    fut = rows.filter("part = 'future'").orderBy("step").collect()
    assert [r.pos for r in fut] == [30, 31, 32]
    assert [r.ds for r in fut] == [D0 + dt.timedelta(30 + i) for i in range(3)]
    base = {(r.fold, r.step): r.yhat for r in last_value_forecast(rows).collect()}
    assert base[(0, 1)] == 4.0  # fold 0 trains on positions 0..4 (30 - 5 * 5)
    assert base[(5, 3)] == 29.0  # final fit: last value of the series


def test_fold_sizes_and_align(spark):
    sizes = {(r.fold, r.part): r.n for r in B.fold_sizes(B.expanding_folds(_series(spark, 36), 5)).collect()}
    assert sizes[(0, "train")] == 6 and sizes[(4, "train")] == 30 and sizes[(2, "test")] == 6
    a = spark.createDataFrame([("w", 0, 1, 1.0), ("w", 0, 2, 2.0)], "well string, fold int, step int, y double")
    f = spark.createDataFrame([("w", 0, 1, 1.5)], "well string, fold int, step int, yhat double")
    assert B.align(a, f).count() == 1
