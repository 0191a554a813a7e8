"""Pooled quantile regression: against plain sums, the pinball loss, coverage on held-out folds, edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.functions import pinball as PB
from boreflow.plans import forecast as FC
from boreflow.plans.models import quantile as Q
from boreflow.session import cut_lineage

D0 = dt.date(2020, 1, 1)


def noisy(k, n):
    """Weekly waves with noise that grows on weekends."""
    rng = np.random.default_rng(40 + k)
    t = np.arange(n)
    return 40.0 * (k + 1) * (1 + 0.3 * np.sin(2 * math.pi * t / 7) + np.where(t % 7 < 2, 0.3, 0.08) * rng.normal(size=n))


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f"w{k}", D0 + dt.timedelta(i), float(v)) for k in range(5) for i, v in enumerate(noisy(k, 400))]
    return spark.createDataFrame(rows, "well string, ds date, y double").repartition(3).cache()


def plain_fit(wells, n_input, ahead, lam):
    """All windows as rows, reweighted least squares one class and quantile at a time."""
    epoch = (D0 - dt.date(1970, 1, 1)).days
    out = {}
    for c, (lo, hi) in enumerate(ahead):
        rows, target = [], []
        for y in wells:
            for i in range(len(y) - n_input):
                at = i + n_input - 1 + lo + i % (hi - lo + 1)
                if at < len(y):
                    scale = np.mean(np.abs(y[i : i + n_input]))
                    d = epoch + at
                    waves = [f(2 * math.pi * k * d / p) for p, order in PB.WAVES for k in range(1, order + 1) for f in (math.sin, math.cos)]
                    rows.append([1.0, *(y[i : i + n_input] / scale), *waves])
                    target.append(y[at] / scale)
        x, t = np.array(rows), np.array(target)
        pen = lam * (np.arange(x.shape[1]) > 0)

        def ridge(w, x=x, t=t, pen=pen):
            g = (x * w[:, None]).T @ x
            return np.linalg.solve(g + np.diag(pen * np.diag(g) + 1e-10 * (1 + np.diag(g))), (x * w[:, None]).T @ t)

        for j, q in enumerate(PB.QUANTILES):
            b = ridge(np.ones(len(t)))
            for k in range(PB.ROUNDS):
                r = t - x @ b
                b = ridge(np.where(r < 0, 1 - q, q) / np.maximum(np.abs(r), PB.floor_of(k)))
            out[c, j] = (b, x, t)
    return out


def test_coefficients_equal_plain_sums_and_minimise_the_pinball_loss(spark, panel):
    from boreflow.plans.series import cut_series

    ahead = PB.classes(2, 5)
    assert ahead == [(1, 1), (2, 2), (3, 4), (5, 8)]
    staged, last = cut_series(panel, "y", 5)
    got = Q.fit_quantiles(staged, 6, ahead, 1e-3)
    assert {k[0] for k in got} == set(range(6)) and len(got) == 6 * 4 * 3
    want = plain_fit([noisy(k, 400) for k in range(5)], 6, ahead, 1e-3)
    rng = np.random.default_rng(1)
    for (c, j), (b, x, t) in want.items():
        assert np.allclose(got[last, c, j], b, rtol=1e-5, atol=1e-7)
        q = PB.QUANTILES[j]
        loss = lambda b, q=q, x=x, t=t: np.mean(np.maximum(q * (t - x @ b), (q - 1) * (t - x @ b)))
        assert all(loss(b + rng.normal(scale=0.03, size=len(b))) > 0.995 * loss(b) for _ in range(30))
        assert abs(np.mean(t <= x @ b) - q) < 0.04


def test_coverage_on_held_out_folds(spark):
    rows = [(f"w{k}", D0 + dt.timedelta(i), float(v)) for k in range(16) for i, v in enumerate(noisy(k, 480))]
    fc = FC.forecast(spark.createDataFrame(rows, "well string, ds date, y double"), "y", "TFT", horizon=10)
    fc = cut_lineage(fc)
    rows = fc.filter("part = 'test' and fold >= 1").collect()
    inside = np.mean([r.yhat_lower <= r.y <= r.yhat_upper for r in rows])
    assert 0.75 <= inside <= 0.85
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in rows)
    wide = lambda days: np.mean([(r.yhat_upper - r.yhat_lower) / r.yhat for r in rows if (r.pos % 7 < 2) == days])
    assert wide(True) > 1.3 * wide(False)  # the band is wider where the noise is
    future = fc.filter("part = 'future'").collect()
    assert len(future) == 160 and all(r.params["n_input"] == "24" for r in future)


def test_one_pass_per_round_and_no_copy_of_windows(spark, panel):
    from boreflow.plans.series import cut_series

    staged, _ = cut_series(panel, "y", 3)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_gaps_short_wells_and_empty_panels(spark):
    rows = [("long", D0 + dt.timedelta(i), None if i % 50 == 3 else float(v)) for i, v in enumerate(noisy(1, 300))]
    rows += [("short", D0 + dt.timedelta(i), 10.0 + i) for i in range(4)]
    panel = spark.createDataFrame(rows, "well string, ds date, y double")
    out = FC.forecast(panel, "y", "TFT", horizon=4, params={"n_input": 8, "n_out": 3}).filter("part = 'future'").collect()
    assert len(out) == 8 and all(math.isfinite(r.yhat) and r.yhat_lower <= r.yhat_upper for r in out)
    alone = FC.forecast(panel.filter("well = 'short'"), "y", "TFT", horizon=4).filter("part = 'future'").collect()
    assert [r.yhat for r in alone] == [13.0] * 4 and all(r.yhat_lower is None for r in alone)
    assert FC.forecast(panel.filter(F.lit(False)), "y", "TFT", horizon=4).count() == 0
