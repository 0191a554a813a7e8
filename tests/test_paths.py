import datetime as dt

import numpy as np

from boreflow.plans import forecast as FC
from boreflow.plans import tune as TU
from boreflow.plans.models import paths as P

PRIME = 2147483647


def walk(y, h, n_paths, seed, fold):
    """Paths one by one, step by step."""
    d = [b - a for a, b in zip(y, y[1:])]
    out = []
    for p in range(1, n_paths + 1):
        total, row = 0.0, []
        for j in range(1, h + 1):
            k = (p * 7919 + j * 104729 + p * j * 31 + fold * 15485863 + seed * 32452843) % PRIME
            k = k * 48271 % PRIME
            total += d[k * k % PRIME % len(d)]
            row.append(total)
        out.append(row)
    return np.array(out)


def test_quantiles_equal_explicit_paths():
    y = np.random.default_rng(1).normal(size=90).cumsum()
    got = P.path_quantiles(np.diff(y), 600, 40, 7, 3, (0.05, 0.95))
    assert np.allclose(got, np.quantile(walk(list(y), 600, 40, 7, 3), (0.05, 0.95), axis=0))
    assert (P.path_quantiles(np.array([]), 4, 9, 1, 0, (0.5,)) == 0).all()


def panel(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(w, dt.date(2024, 1, 1) + dt.timedelta(i), float(20 + 3 * np.sin(i / 3 + k) + rng.normal())) for k, w in enumerate("ab") for i in range(n)]
    return spark.createDataFrame(rows, "well string, ds date, y double")


def test_bootstrap_band_of_a_forecast(spark):
    df = panel(spark)
    y = [r.y for r in df.filter("well = 'a'").orderBy("ds").collect()]
    fc = FC.forecast(df, "y", "ETS", horizon=5, params={"n_bootstrap_draws": 30}).filter("part = 'future' and well = 'a'").orderBy("step").collect()
    lo, hi = np.quantile(walk(y, 5, 30, 7, 5), (0.05, 0.95), axis=0)
    assert np.allclose([r.yhat_lower - r.yhat for r in fc], lo) and np.allclose([r.yhat_upper - r.yhat for r in fc], hi)
    paths = FC.forecast(df, "y", "Chronos", horizon=5).filter("part = 'future' and well = 'a'").orderBy("step").collect()
    assert np.allclose([r.yhat for r in paths], y[-1] + np.quantile(walk(y, 5, 20, 42, 5), 0.5, axis=0))


def test_tuned_wells_run_with_their_own_values(spark):
    df = panel(spark)
    for model in ("ETS", "Chronos", "N-BEATS"):
        tuned = {r.well: r for r in TU.tune(df, "y", model, 5, seed=2).collect()}
        fc = TU.forecast_tuned(df, "y", model, TU.tune(df, "y", model, 5, seed=2), 5, seed=2, horizon=4)
        rows = fc.filter("part = 'future'").collect()
        assert sorted((r.well, r.step) for r in rows) == [(w, s) for w in "ab" for s in range(1, 5)]
        assert all(r.trial == tuned[r.well].trial and r.params == tuned[r.well].params for r in rows)


def test_no_frame_stays_in_storage(spark):
    spark.catalog.clearCache()
    for model in ("ETS", "DLT", "Prophet", "LSTM", "Chronos", "KTR"):
        FC.forecast(panel(spark, 60), "y", model, horizon=2).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
