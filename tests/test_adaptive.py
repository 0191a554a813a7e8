"""Adaptive tuning: one round against a plain version, the whole search against random draws."""

import datetime as dt
import math
import zlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.functions import parzen as PZ
from boreflow.operators import clean as C
from boreflow.plans import forecast as FC
from boreflow.plans import tune as TU
from boreflow.session import cut_lineage

D0 = dt.date(2021, 3, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for j, w in enumerate("abcd"):
        t = np.arange(260)
        x = rng.normal(size=260)
        y = 60 + 6 * j + (j + 1) * np.sin(2 * math.pi * t / 12) + 2 * x + np.cumsum(rng.normal(scale=0.3 * j, size=260)) + rng.normal(size=260)
        rows += [(w, D0 + dt.timedelta(int(i)), float(y[i]), float(x[i])) for i in t]
    return spark.createDataFrame(rows, "well string, ds date, y double, x double").cache()


def plain_round(choices, points, scores, n, seed):
    """The same proposals with scalar loops, densities added up one component at a time."""
    rng = np.random.default_rng(list(seed))
    normal = NormalDist()
    order = sorted(range(len(scores)), key=lambda i: (math.isnan(scores[i]), 0 if math.isnan(scores[i]) else scores[i], i))
    cut = max(1, math.ceil(PZ.GOOD * len(order)))
    sides = order[:cut], order[cut:]

    def parts(xs):
        xs = sorted(xs)
        out = []
        for i, x in enumerate(xs):
            left, right = xs[i - 1] if i else 0.0, xs[i + 1] if i + 1 < len(xs) else 1.0
            out.append((x, min(max(x - left, right - x, 1 / (len(xs) + 2)), 1.0)))
        return [*out, (0.5, 1.0)]

    def density(xs, at):
        ps = parts(xs)
        return sum(normal.pdf((at - c) / w) / w / (normal.cdf((1 - c) / w) - normal.cdf(-c / w)) for c, w in ps) / len(ps)

    def share(xs, at, k):
        place = lambda x: min(int(x * k), k - 1)
        return (sum(place(x) == place(at) for x in xs) + 1) / (len(xs) + k)

    out = []
    for _ in range(n):
        drawn, ratio = [[0.0] * len(choices) for _ in range(PZ.CANDIDATES)], [0.0] * PZ.CANDIDATES
        for j, k in enumerate(choices):
            u, v = rng.random(PZ.CANDIDATES), rng.random(PZ.CANDIDATES)
            good, bad = ([points[i][j] for i in s] for s in sides)
            for c in range(PZ.CANDIDATES):
                if k:
                    low, i = 0.0, 0
                    while i < k - 1 and u[c] >= low + share(good, (i + 0.5) / k, k):
                        low += share(good, (i + 0.5) / k, k)
                        i += 1
                    x = (i + 0.5) / k
                    ratio[c] += math.log(share(good, x, k) / share(bad, x, k))
                else:
                    ps = parts(good)
                    m, w = ps[min(int(u[c] * len(ps)), len(ps) - 1)]
                    a, b = normal.cdf(-m / w), normal.cdf((1 - m) / w)
                    x = m + w * normal.inv_cdf(a + v[c] * (b - a))
                    ratio[c] += math.log(density(good, x) / density(bad, x))
                drawn[c][j] = x
        out.append(drawn[max(range(PZ.CANDIDATES), key=lambda c: (ratio[c], -c))])
    return out


@pytest.mark.parametrize("n_trials", [1, 2, 10, 25])
def test_one_round_equals_the_plain_version(n_trials):
    rng = np.random.default_rng(n_trials)
    points, scores = rng.random((n_trials, 4)), rng.random(n_trials)
    scores[n_trials // 2] = float("nan")
    scores[-1] = scores[0]
    got = PZ.propose([0, 3, 0, 4], points, scores.tolist(), 6, (7, 1, 99))
    assert np.allclose(got, plain_round([0, 3, 0, 4], points.tolist(), scores.tolist(), 6, (7, 1, 99)), atol=1e-9)
    assert (got >= 0).all() and (got <= 1).all()


def test_densities_add_up_to_one():
    x = (np.arange(20_000) + 0.5) / 20_000
    for pts in (np.array([]), np.array([0.02]), np.array([0.3, 0.31, 0.9])):
        assert abs(np.exp(PZ.log_density(pts, x)).mean() - 1.0) < 1e-6


@pytest.fixture(scope="module")
def many(spark):
    """Two dozen wells: season, drift and level changes of different strength."""
    rng = np.random.default_rng(8)
    rows = []
    for j in range(24):
        t = np.arange(220)
        y = 80 + 4 * (j % 3) * np.sin(2 * math.pi * t / 12) + np.cumsum(rng.normal(scale=0.4 * (j % 4), size=220)) + rng.normal(scale=2, size=220)
        rows += [(f"w{j}", D0 + dt.timedelta(int(i)), float(y[i])) for i in t]
    return spark.createDataFrame(rows, "well string, ds date, y double").cache()


@pytest.mark.parametrize("model", ["ETS", "DLT"])
def test_twenty_five_fits_reach_fifty_random_trials(many, model):
    """Over the wells (geometric mean of RMSE ratios); a single well's best of fifty can be luck."""
    def rmse(df):
        return {r.well: r.rmse for r in df.collect()}

    fifty, some = rmse(TU.tune(many, "y", model, 50)), rmse(TU.tune(many, "y", model, 25))
    found = TU.tune_adaptive(many, "y", model).collect()
    assert len(found) == 24 and all(r.fits == 25 for r in found)
    ratio = lambda other: float(np.exp(np.mean([math.log(r.rmse / other[r.well]) for r in found])))
    assert ratio(fifty) <= 1.01 and ratio(some) < 1.0


def test_the_search_is_deterministic(panel):
    runs = [{r.well: (r.trial, r.params, r.rmse) for r in TU.tune_adaptive(df, "y", "LGT", 6, 2, 2, regressors=["x"]).collect()} for df in (panel, panel.repartition(3))]
    assert all(runs[0][w][:2] == runs[1][w][:2] and math.isclose(runs[0][w][2], runs[1][w][2], rel_tol=1e-9) for w in "abcd")


def test_the_state_is_what_the_trials_scored(panel):
    """Every trial's RMSE in the state is that of its own weights, and proposals follow from the state alone."""
    state = TU._search_per_well(panel, "y", "ETS", 6, 2, 3, 9, [], "well")
    rows = {(r.well, r.trial): r for r in state.collect()}
    assert len(rows) == 4 * 12
    points = TU.start_points(TU.SPACES["ETS"], 6, 9)
    start = [TU.trial_at(TU.SPACES["ETS"], p) for p in points]
    assert all(sorted((points[:, j] * 6).astype(int)) == list(range(6)) for j in range(2))
    for w in "abcd":
        assert all(math.isclose(float(rows[w, i].params["alpha"]), start[i]["alpha"]) for i in range(6))
        want = PZ.propose([0, 0], points, [rows[w, i].rmse for i in range(6)], 3, (9, 1, zlib.crc32(w.encode())))
        for i in range(3):
            trial = TU.trial_at(TU.SPACES["ETS"], want[i])
            assert math.isclose(float(rows[w, 6 + i].params["gamma"]), trial["gamma"], abs_tol=1e-12)
    one = FC.forecast(panel.filter("well = 'b'"), "y", "ETS", horizon=0, holdout=TU.HOLDOUT, params={
        "alpha": rows["b", 10].params["alpha"], "gamma": rows["b", 10].params["gamma"], "n_bootstrap_draws": 0}).filter("part = 'test'")
    assert math.isclose(one.agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2))).first()[0], rows["b", 10].rmse, rel_tol=1e-9)


@pytest.mark.parametrize("model", ["KTR", "Prophet", "Chronos", "LSTM", "N-BEATS"])
def test_shared_trials(panel, model):
    tuned = cut_lineage(TU.tune_adaptive(panel, "y", model, 2, 1, 1, regressors=["x"]))
    best = {r.well: r for r in tuned.collect()}
    assert set(best) == set("abcd") and all(r.rmse > 0 and r.trial is not None for r in best.values())
    finite = TU.finite_space(TU.SPACES[model])
    assert all(r.fits == len(finite) if finite else r.fits <= 3 for r in best.values())
    rows = TU.forecast_tuned(panel, "y", model, tuned, regressors=["x"], horizon=3).filter("part = 'future'").collect()
    assert len(rows) == 12 and all(r.params == best[r.well].params and r.trial == best[r.well].trial for r in rows)


def _awkward_panel(spark):
    day = lambda i: D0 + dt.timedelta(i)
    rows = [("one", day(0), 5.0, 1.0)] + [("two", day(i), 5.0 + i, 1.0) for i in range(2)]
    rows += [("ten", day(i), 5.0 + i, 1.0 + i % 3) for i in range(10)] + [("long", day(i), 20.0 + i % 7, 2.0 + i % 5) for i in range(80)]
    return C.clean(spark.createDataFrame(rows, "well string, ds date, y double, z double"), ["y", "z"], target="y")


@pytest.mark.parametrize("model", FC.MODELS)
def test_no_well_is_lost_between_tuning_and_forecast(spark, model):
    """Wells whose hold-out cannot be scored are tuned to the defaults and still get their whole horizon."""
    df = _awkward_panel(spark)
    tuned = cut_lineage(TU.tune(df, "y", model, 2, regressors=["z"]))
    rows = {r.well: r for r in tuned.collect()}
    assert set(rows) == {"one", "two", "ten", "long"}
    for r in rows.values():
        assert (r.trial is None) == (r.rmse is None) == (r.n == 0)
        assert r.trial is not None or r.params == {k: str(v) for k, v in FC.DEFAULTS[model].items()}
    fc = TU.forecast_tuned(df, "y", model, tuned, regressors=["z"], horizon=5).filter("part = 'future'").collect()
    assert sorted((r.well, r.step) for r in fc) == sorted((w, s) for w in rows for s in range(1, 6))
    assert all(r.yhat is not None and math.isfinite(r.yhat) for r in fc)
