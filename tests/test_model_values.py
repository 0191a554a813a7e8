"""Whole forecasts of the regression-type models against plain NumPy written from their definitions."""

import datetime as dt
import math
from collections import defaultdict

import numpy as np
import pytest

from boreflow.plans.models import ktr, lags, smoothing

D0 = dt.date(2021, 3, 1)
N, WELLS = 90, ("a", "b", "c")


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    t = np.arange(N)
    out = {}
    for j, w in enumerate(WELLS):
        x = rng.normal(size=N)
        out[w] = (40 * (j + 1) + 0.1 * t + 5 * np.sin(2 * math.pi * t / 12) + 2 * x + rng.normal(size=N), x)
    return out


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [(w, D0 + dt.timedelta(int(i)), float(y[i]), float(x[i])) for w, (y, x) in series.items() for i in range(N)]
    return spark.createDataFrame(rows, "well string, ds date, y double, x double").repartition(3).cache()


def by_fold(forecast):
    """{(well, fold): (train_end, {step: (yhat, lower, upper)})}; every fold has its whole run of steps."""
    out = defaultdict(dict)
    for r in forecast.collect():
        out[r.well, r.fold, r.train_end][r.step] = (r.yhat, r.yhat_lower, r.yhat_upper)
    assert len(out) == len(WELLS) * 6
    for steps in out.values():
        assert sorted(steps) == list(range(1, len(steps) + 1))
    return {(w, f): (end, steps) for (w, f, end), steps in out.items()}


def ridge(a, y, lam, penalised, weight=None):
    wa = a if weight is None else a * weight[:, None]
    gram = wa.T @ a
    return np.linalg.solve(gram + lam * np.diag(np.diag(gram) * penalised), wa.T @ y)


def scaled_windows(y, end, n_in, n_out):
    for s in range(end - n_in - n_out + 1):
        x, scale = y[s : s + n_in], np.mean(np.abs(y[s : s + n_in]))
        yield np.concatenate([[1.0], x / scale]), y[s + n_in : s + n_in + n_out] / scale


@pytest.mark.parametrize("mode", ["direct", "recursive", "pooled"])
def test_lag_forecasts_by_definition(panel, series, mode):
    n_in, n_out, lam = 5, 3, 0.1
    got = by_fold(lags.lag_forecast(panel, "y", 8, n_in, n_out, mode, lam))
    for (well, fold), (end, steps) in got.items():
        used = WELLS if mode == "pooled" else (well,)
        pairs = [p for w in used for p in scaled_windows(series[w][0], end, n_in, n_out)]
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        beta = [ridge(a, b[:, k], lam, np.array([0.0] + [1.0] * n_in)) for k in range(n_out)]
        values = list(series[well][0][:end])
        while len(values) < end + len(steps):
            last = np.array(values[-n_in:])
            scale = np.mean(np.abs(last))
            x = np.concatenate([[1.0], last / scale])
            values += [scale * float(x @ beta[k]) for k in range(1 if mode == "recursive" else n_out)]
        np.testing.assert_allclose([steps[k][0] for k in sorted(steps)], values[end : end + len(steps)], rtol=1e-6)


def test_ktr_by_definition(panel, series):
    knots, lam = 6, 0.5
    got = by_fold(ktr.ktr(panel, "y", ["x"], 8, knots, ktr.candidates(["x"], (lam,))))

    def feature(pos, x):
        waves = [g(2 * math.pi * k * pos / 12) for k in (1, 2) for g in (np.sin, np.cos)]
        return np.array([1.0, *waves, x])

    for (well, fold), (end, steps) in got.items():
        y, x = series[well]
        a = np.array([feature(p, x[p]) for p in range(end)])
        centres = [end * (j + 0.5) / knots for j in range(knots)]

        def weight(pos, c, end=end):
            return np.exp(-0.5 * ((pos - c) / (end / knots)) ** 2)

        betas = [ridge(a, y[:end], lam, np.array([0.0] + [1.0] * 5), weight(np.arange(end), c)) for c in centres]
        held = np.array([weight(end - 1, c) for c in centres])
        for step, (yhat, _, _) in steps.items():
            pos = end - 1 + step
            f = feature(pos, x[pos] if pos < N else x[-1])
            assert yhat == pytest.approx(sum(h * (f @ b) for h, b in zip(held, betas, strict=True)) / held.sum(), rel=1e-6)


@pytest.mark.parametrize("kind", ["dlt", "lgt"])
def test_trend_smoothers_by_definition(panel, series, kind):
    lam = 0.2
    g = {"alpha": 0.3, "beta": 0.1, "gamma": 0.2}
    g |= {"phi": 0.9} if kind == "dlt" else {"xi1": 0.5, "xi2": 0.01, "lam": 0.5}
    stage1 = smoothing.stage1_candidates(kind, ["x"], ("linear",), ("fixed_ridge",), lam)
    got = by_fold(smoothing.smoothing_forecast(panel, "y", kind, ["x"], stage1, [g], 8))
    for (well, fold), (end, steps) in got.items():
        y, x = series[well]

        def feature(pos, v, end=end):
            return np.array([1.0, pos / end, v] if kind == "dlt" else [v])

        a = np.array([feature(p, x[p]) for p in range(end)])
        beta = ridge(a, y[:end], lam, np.array([0.0, 0.0, 1.0] if kind == "dlt" else [1.0]))
        r = y[:end] - a @ beta
        level, trend, season, errors = r[0], 0.0, [0.0] * 12, []

        def ahead(level, trend):
            if kind == "dlt":
                return level + g["phi"] * trend
            return level + g["xi1"] * trend + g["xi2"] * math.copysign(abs(level) ** g["lam"], level)

        for t in range(1, end):
            base, due = ahead(level, trend), season[t % 12]
            e = r[t] - base - due
            errors.append(e)
            new = base + g["alpha"] * e
            trend = g["phi"] * trend + g["beta"] * e if kind == "dlt" else g["beta"] * (new - level) + (1 - g["beta"]) * trend
            level = new
            season[t % 12] = due + g["gamma"] * (1 - g["alpha"]) * e
        sd = math.sqrt(np.mean(np.square(errors)))
        for step in sorted(steps):
            level = ahead(level, trend)
            trend = g["phi"] * trend if kind == "dlt" else trend
            pos = end - 1 + step
            want = feature(pos, x[pos] if pos < N else x[-1]) @ beta + level + season[pos % 12]
            assert steps[step] == pytest.approx((want, want - 1.6449 * sd, want + 1.6449 * sd), rel=1e-6)
