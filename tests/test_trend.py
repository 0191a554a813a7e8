"""Trend with sparse changepoints: planted changes, factors of any sign, the band's variance, whole forecasts."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.functions import trend as TR
from boreflow.operators.backtest import backtest_rows
from boreflow.plans import forecast as FC
from boreflow.plans.models import fourier

D0 = dt.date(2019, 1, 1)
DAYS = np.arange((D0 - dt.date(1970, 1, 1)).days, (D0 - dt.date(1970, 1, 1)).days + 1300).astype(float)


def planted(n, at, slope, rng, noise=0.5):
    t = np.arange(n)
    return 50 + 0.02 * t + sum(s * np.maximum(t - a, 0) for a, s in zip(at, slope)) + rng.normal(scale=noise, size=n)


def test_planted_changepoints_are_found_and_the_others_stay_at_zero():
    n = 1000
    cuts = 0.8 * np.arange(1, 26) / 25 * n
    y = planted(n, [cuts[7], cuts[17]], [0.15, -0.25], np.random.default_rng(1))
    fit = TR.fit_series(y, DAYS, [(0, n, n, 100)], [(False, False, False)], 1.28)[0]
    delta = np.array(fit["delta"]) / n  # per day
    around = lambda j: delta[j - 1 : j + 2].sum()
    assert abs(around(7) - 0.15) < 0.02 and abs(around(17) + 0.25) < 0.02
    quiet = np.delete(delta, [6, 7, 8, 16, 17, 18])
    assert np.abs(quiet).max() < 0.01 and (np.abs(quiet) < 1e-4).mean() > 0.5
    truth = 50 + 0.02 * np.arange(n, n + 100) + 0.15 * (np.arange(n, n + 100) - cuts[7]) - 0.25 * (np.arange(n, n + 100) - cuts[17])
    assert np.sqrt(np.mean((np.array(fit["fc"]) - truth) ** 2)) < 3.0


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_multiplicative_factors_of_any_sign(sign):
    n = 730
    t = np.arange(n + 60)
    level = 20 + 0.1 * t
    truth = sign * level * (1 + 0.3 * np.sin(2 * math.pi * DAYS[: n + 60] / 7))
    y = truth[:n] + np.random.default_rng(2).normal(scale=0.5, size=n)
    add, mul = TR.fit_series(y, DAYS[: n + 60], [(0, n, n, 60)], [(False, False, True), (True, False, True)], 1.28)
    rmse = [float(np.sqrt(np.mean((np.array(f["fc"]) - truth[n:]) ** 2))) for f in (add, mul)]
    assert rmse[1] < 1.5 and rmse[1] < 0.3 * rmse[0]


def test_zeros_in_the_target_do_not_matter():
    y = np.where(np.arange(400) % 5 == 0, 0.0, 10.0) + np.random.default_rng(3).normal(scale=0.1, size=400)
    y[::50] = np.nan
    fit = TR.fit_series(y, DAYS, [(0, 400, 400, 10)], [(True, True, True)], 1.28)[0]
    assert np.isfinite(fit["fc"]).all() and np.all(np.array(fit["lo"]) < np.array(fit["hi"]))
    assert TR.fit_series(np.full(9, np.nan), DAYS, [(0, 9, 9, 3)], [(True, True, True)], 1.28) == []


def test_map_fit_is_a_minimum_of_the_penalised_error():
    rng = np.random.default_rng(4)
    x = np.concatenate([TR.trend_columns(np.arange(300.0), 300), TR.season_columns(DAYS[:300])], axis=1)
    y = x[:, 1] * 0.4 + 0.3 * x[:, 40] + rng.normal(scale=0.05, size=300)
    k = x.shape[1]
    laplace, normal = np.arange(k) >= 2, np.arange(k) >= 27
    laplace &= ~normal
    beta, _ = TR.map_fit(x.T @ x, x.T @ y, float(y @ y), 300, laplace, normal, 60)
    var = np.mean((y - x @ beta) ** 2)

    def cost(b):
        return 0.5 * np.sum((y - x @ b) ** 2) + var * np.abs(b[laplace]).sum() / TR.CHANGEPOINT_SCALE + 0.5 * var * np.sum(b[normal] ** 2) / TR.SEASON_SCALE**2

    base = cost(beta)
    for _ in range(300):
        assert cost(beta + rng.normal(scale=10.0 ** rng.uniform(-5, -1)) * rng.normal(size=k)) > base - 1e-4


def test_band_variance_equals_simulated_rate_changes():
    delta, end, h = np.array([0.3, 0.0, -0.1, 0.2]), 40, 25
    rng = np.random.default_rng(5)
    draws = rng.random((200_000, h)) < len(delta) / end
    jumps = np.where(draws, rng.laplace(scale=np.abs(delta).mean(), size=draws.shape), 0.0)
    # a change in a step moves the trend from the next one on
    moved = np.cumsum(np.cumsum(jumps, axis=1), axis=1) / end - np.cumsum(jumps, axis=1) / end
    want = moved.var(axis=0)
    got = TR.future_variance(delta, end, np.arange(1, h + 1))
    assert np.allclose(got[1:], want[1:], rtol=0.03) and got[0] == 0.0


def test_rows_equal_the_fits_of_each_training_part(spark):
    rng = np.random.default_rng(6)
    rows = [(w, D0 + dt.timedelta(i), float(v)) for k, w in enumerate(("a", "b")) for i, v in enumerate(planted(200 + 40 * k, [90], [0.2], rng))]
    panel = spark.createDataFrame(rows, "well string, ds date, y double")
    for holdout, include_last in ((None, False), (None, True), ((0.7, 0.95), False)):
        fc = fourier.fourier_trend(panel, "y", 6, fourier.candidates([("additive", True, True), ("multiplicative", False, True)]), holdout=holdout, include_last=include_last)
        got = {(r.well, r.fold, r.params["seasonality_mode"], r.step): r for r in fc.collect()}
        frame = backtest_rows(panel, "y", [], 5, 6, None, include_last, holdout).filter("part <> 'train'").collect()
        assert len(got) == 2 * len(frame)
        for r in frame:
            mine = got[r.well, r.fold, "additive", r.step]
            assert (mine.ds, mine.y, mine.pos, mine.train_end, mine.part) == (r.ds, r.y, r.pos, r.train_end, r.part)
        y = np.array([v for w, _, v in rows if w == "b"])
        folds = {(r.fold, r.train_end) for r in frame if r.well == "b"}
        days = np.arange(DAYS[0], DAYS[0] + len(y) + 6)
        for fold, end in folds:
            steps = sorted(r.step for r in frame if r.well == "b" and r.fold == fold)
            begin = min(r.pos for r in frame if r.well == "b" and r.fold == fold)
            fits = TR.fit_series(y, days, [(fold, end, begin, len(steps))], [(False, True, True), (True, False, True)], 1.2816)
            for mode, fit in zip(("additive", "multiplicative"), fits):
                assert np.allclose([got["b", fold, mode, s].yhat for s in steps], fit["fc"])
                assert np.allclose([got["b", fold, mode, s].yhat_upper for s in steps], fit["hi"])


def test_only_one_shuffle_by_well(spark):
    rows = [("a", D0 + dt.timedelta(i), float(i % 7)) for i in range(60)]
    fc = fourier.fourier_trend(spark.createDataFrame(rows, "well string, ds date, y double"), "y", 5)
    plan = fc._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_wells_no_rows(spark):
    empty = spark.createDataFrame([], "well string, ds date, y double")
    assert FC.forecast(empty, "y", "Prophet", horizon=3).count() == 0
    one = spark.createDataFrame([("w", D0, None), ("w", D0 + dt.timedelta(1), None)], "well string, ds date, y double")
    assert FC.forecast(one, "y", "Prophet", horizon=3).filter(F.col("yhat").isNotNull()).count() == 0
