import datetime as dt

import numpy as np
import pandas as pd
import pytest

from boreflow.functions.stats import t_two_sided_p
from boreflow.operators import screen as S

D0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for w in ("a", "b"):
        x = np.cumsum(rng.normal(size=80))
        z = rng.integers(0, 5, 80).astype(float)  # many ties for the rank test
        y = 2 * x + rng.normal(size=80)
        rows += [(w, D0 + dt.timedelta(i), float(y[i]), float(x[i]), float(z[i])) for i in range(80)]
    return spark.createDataFrame(rows, "well string, ds date, y double, x double, z double"), pd.DataFrame(
        rows, columns=["well", "ds", "y", "x", "z"])


def test_acf_matches_numpy(panel):
    df, pdf = panel
    got = {(r.well, r.param, r.lag): r.acf for r in S.acf(df, ["x"], 20).collect()}
    for w, g in pdf.groupby("well"):
        v = g.sort_values("ds")["x"].to_numpy()
        c = v - v.mean()
        den = (c * c).sum()
        for k in range(21):
            exp = (c[k:] * c[: len(c) - k]).sum() / den
            assert abs(got[(w, "x", k)] - exp) < 1e-12


def test_pearson_and_spearman(panel):
    df, pdf = panel
    r = {(x.well, x.regressor): x.r for x in S.corr_with_target(df, "y", ["x", "z"]).collect()}
    sp = {(x.well, x.regressor): x for x in S.spearman(df, "y", ["x", "z"]).collect()}
    for w, g in pdf.groupby("well"):
        for c in ("x", "z"):
            assert abs(r[(w, c)] - g["y"].corr(g[c])) < 1e-12
            assert abs(sp[(w, c)].rho - g["y"].rank().corr(g[c].rank())) < 1e-12
            assert np.isfinite(sp[(w, c)].p)


def test_t_pvalues_against_table():
    # two-sided critical values of Student's t: p = 0.05 at (df, t)
    for dof, t in ((1, 12.706), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert abs(t_two_sided_p(np.array([t]), np.array([float(dof)]))[0] - 0.05) < 5e-4
    assert abs(t_two_sided_p(np.array([0.0]), np.array([10.0]))[0] - 1.0) < 1e-12


def test_screen_flags(panel):
    df, _ = panel
    out = {(r.well, r.regressor): r for r in S.screen(df, "y", ["x", "z"]).collect()}
    assert all(out[(w, "x")].significant for w in ("a", "b"))
    assert {(w, c) for (w, c) in out} == {("a", "x"), ("a", "z"), ("b", "x"), ("b", "z")}
    sig = {(r.well, r.regressor) for r in S.significant(S.screen(df, "y", ["x", "z"])).collect()}
    assert ("a", "x") in sig


def test_screen_agrees_with_its_operators_on_nulls_ties_and_constants(spark):
    rng = np.random.default_rng(7)
    rows = []
    for w, days in (("a", 90), ("b", 40), ("short", 3), ("one", 1)):
        for i in rng.permutation(days):
            x = float(rng.integers(0, 6))
            rows.append((w, D0 + dt.timedelta(int(i)), float(rng.normal() + x), x if rng.random() > 0.2 else None, 0.1, None if w == "a" else float(i)))
    df = spark.createDataFrame(rows, "well string, ds date, y double, x double, flat double, z double")
    regs = ["x", "flat", "z"]
    got = {(r.well, r.regressor): r for r in S.screen(df, "y", regs).collect()}
    acf = {(r.well, r.param): r.acf_max for r in S.acf_screen(S.acf(df, regs)).collect()}
    r_ = {(r.well, r.regressor): r.r for r in S.corr_with_target(df, "y", regs).collect()}
    rho = {(r.well, r.regressor): r for r in S.spearman(df, "y", regs).collect()}
    assert set(got) == set(rho) and len(got) == 12

    def same(a, b):
        return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)

    for k, row in got.items():
        assert same(row.r, r_[k]) and same(row.rho, rho[k].rho) and same(row.p, rho[k].p) and row.n == rho[k].n, k
        if k[1] != "flat":  # the mean of equal values, and with it a correlation of nothing, depends on the order of adding
            assert same(row.acf_max, acf[k]), k
        else:
            assert row.acf_max is None and row.r is None


def test_rounding_is_sparks_own(spark):
    from pyspark.sql import functions as F

    from boreflow.plans.queries import _r

    rng = np.random.default_rng(11)
    values = [0.0, -0.0, 1e300, -1e300, float("nan"), float("inf"), None, 2.5e-10, 0.0000000015, 1.0000000005, 123456.7890123455, 4.5e15]
    values += [float(x) for x in rng.normal(0, 1e5, 3000)] + [float(a) / 2**k for k in range(1, 40) for a in rng.integers(-10**6, 10**6, 30)]
    values += [float(f"{a}.{b:09d}5") for a, b in zip(rng.integers(0, 10**5, 500), rng.integers(0, 10**9, 500), strict=True)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 6, 9):
        both = _r(df.withColumn("w", F.round("v", digits)).withColumn("w", F.col("w").cast("string")), digits)
        assert both.filter(~F.col("v").cast("string").eqNullSafe(F.col("w"))).count() == 0
