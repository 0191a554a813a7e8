import numpy as np
from pyspark.sql import functions as F

from boreflow.functions import linalg as L


def test_gram_and_solve_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    truth = {"a": np.array([1.0, -2.0, 0.5]), "b": np.array([3.0, 0.0, 1.0])}
    for g, beta in truth.items():
        x = rng.normal(size=(200, 2))
        y = beta[0] + x @ beta[1:] + rng.normal(scale=0.01, size=200)
        rows += [(g, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, y double").repartition(5)
    feats = [F.lit(1.0), F.col("x1"), F.col("x2")]
    gm = L.gram(df, ["g"], feats, [F.col("y")])
    sol = gm.select("g", "n", "xtx", L.solve("xtx", "xty_0", "yty_0", L.bool_array([True] * 3), L.dbl_array([0, 0, 0]),
                                            F.lit(0.0), F.lit(0)).alias("s")).collect()
    for r in sol:
        sub = [x for x in rows if x[0] == r.g]
        X = np.array([[1.0, x[1], x[2]] for x in sub])
        y = np.array([x[3] for x in sub])
        exp = np.linalg.lstsq(X, y, rcond=None)[0]
        np.testing.assert_allclose(r.s.beta, exp, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(np.array(r.xtx).reshape(3, 3), X.T @ X, rtol=1e-12)
        assert r.n == 200
        assert abs(r.s.sse - ((y - X @ exp) ** 2).sum()) < 1e-6


def test_ridge_lasso_and_mask():
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    b = np.array([1.0, 2.0])
    one = lambda lam, pen, method: L._solve_stack(a[None], b[None], np.array([lam]), pen[None], method)[0][0]
    ols = one(0.0, np.zeros(2), 0)
    np.testing.assert_allclose(a @ ols, b)
    ridge = one(0.5, np.ones(2), 1)
    np.testing.assert_allclose((a + np.diag(0.5 * np.diag(a))) @ ridge, b)
    lasso = one(100.0, np.ones(2), 2)
    assert np.allclose(lasso, 0.0)  # a huge L1 penalty zeroes every coefficient


def test_numpy_feature_builder_matches_columns(spark):
    import datetime as dt

    from boreflow.plans.models import fourier

    rows = [("w", 0, dt.date(2020, 1, 1) + dt.timedelta(i), i, 80, float(10 + (i % 7))) for i in range(80)]
    df = spark.createDataFrame(rows, "well string, fold int, ds date, pos int, train_end int, y double")
    feats, _ = fourier.features()
    a = L.gram(df, ["well", "fold"], feats, [F.col("y")]).collect()[0]
    b = L.gram(df, ["well", "fold"], feats, [F.col("y")], builder=fourier.numpy_features(),
               inputs=fourier.feature_inputs()).collect()[0]
    np.testing.assert_allclose(a.xtx, b.xtx, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(a.xty_0, b.xty_0, rtol=1e-9, atol=1e-9)
    assert a.n == b.n == 80


def test_prefix_gram_equals_per_fold_copies(spark):
    rng = np.random.default_rng(9)
    rows = [("w" + str(i % 2), int(rng.integers(0, 3)), float(rng.normal()), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "well string, block int, x double, y double")
    feats = [F.lit(1.0), F.col("x")]
    pre = {(r.well, r.fold): r for r in L.gram(df, ["well", "block"], feats, [F.col("y")], prefix=("block", "fold", 2)).collect()}
    copies = df.select("*", F.explode(F.sequence(F.col("block"), F.lit(2))).alias("fold"))
    direct = {(r.well, r.fold): r for r in L.gram(copies, ["well", "fold"], feats, [F.col("y")]).collect()}
    assert set(pre) == set(direct)
    for key, r in direct.items():
        np.testing.assert_allclose(pre[key].xtx, r.xtx, rtol=1e-12)
        np.testing.assert_allclose(pre[key].xty_0, r.xty_0, rtol=1e-12)
        assert pre[key].n == r.n
