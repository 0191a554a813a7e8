"""Fitted smoothing weights: against draws, against a plain loop, and replayed by SQL."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.functions import fitting as FI
from boreflow.functions import smoothing as S
from boreflow.plans import forecast as FC
from boreflow.plans.tune import SPACES, draw

D0 = dt.date(2022, 1, 1)


def series(k, n):
    rng = np.random.default_rng(100 + k)
    t = np.arange(n)
    return 200 + 10 * (k % 3) * np.sin(2 * math.pi * t / 12) + np.cumsum(rng.normal(scale=k % 4, size=n)) + rng.normal(scale=3, size=n)


def plain_sse(kind, y, w, m=12):
    """One-step squared error of one series by a loop over its values."""
    level, trend, season, total = y[0], 0.0, [0.0] * m, 0.0
    for t in range(1, len(y)):
        s = season[t % m]
        if kind == "ets":
            base = level
        elif kind == "dlt":
            base = level + w["phi"] * trend
        else:
            base = level + w["xi1"] * trend + w["xi2"] * math.copysign(abs(level) ** w["lam"], level)
        e = y[t] - base - s
        if kind == "lgt":
            new = w["alpha"] * (y[t] - s) + (1 - w["alpha"]) * base
            trend = w["beta"] * (new - level) + (1 - w["beta"]) * trend
            level = new
        else:
            level = base + w["alpha"] * e
            trend = w["phi"] * trend + w["beta"] * e if kind == "dlt" else trend
        season[t % m] = s + w["gamma"] * (1 - w["alpha"]) * e
        total += e * e
    return total


@pytest.mark.parametrize(("kind", "model"), [("ets", "ETS"), ("dlt", "DLT"), ("lgt", "LGT")])
def test_no_worse_than_the_best_of_fifty_draws(kind, model):
    ys = [series(k, n) for k, n in enumerate((40, 90, 200, 400, 700, 61, 333))]
    if kind == "dlt":
        ys = [y - y.mean() for y in ys]
    src = np.repeat(np.arange(len(ys)), 2)
    lens = np.array([n for y in ys for n in (2 * len(y) // 3, len(y))])
    weights, best, steps, settled = FI.fit(kind, ys, src, lens)
    for r, (s, n) in enumerate(zip(src, lens)):
        w = {p: float(v[r]) for p, v in weights.items()}
        assert all(lo <= w[p] <= hi for p, (lo, hi) in FI.BOX[kind].items())
        assert math.isclose(plain_sse(kind, ys[s][:n], w), best[r], rel_tol=1e-9)
        assert best[r] <= min(plain_sse(kind, ys[s][:n], {**S.NEUTRAL, **d}) for d in draw(SPACES[model], 50, 42))
    assert settled.mean() > 0.8 and (steps > 0).all()


def test_a_fit_does_not_depend_on_its_batch_and_held_weights_stay():
    ys = [series(k, 150 + 10 * k) for k in range(6)]
    lens = np.array([len(y) for y in ys])
    together = FI.fit("ets", ys, np.arange(6), lens)
    for k, y in enumerate(ys):
        alone = FI.fit("ets", [y], np.array([0]), np.array([len(y)]))
        assert all(alone[0][p][0] == together[0][p][k] for p in S.PARAMS) and alone[1][0] == together[1][k]
    held = FI.fit("ets", ys, np.arange(6), lens, {"alpha": 0.4})
    assert (held[0]["alpha"] == 0.4).all() and (held[1] >= together[1] * (1 - 1e-6)).all()
    every = FI.fit("ets", ys, np.arange(6), lens, {"alpha": 0.4, "gamma": 0.1})
    assert math.isclose(every[1][2], plain_sse("ets", ys[2], {"alpha": 0.4, "gamma": 0.1}), rel_tol=1e-12) and every[3].all()


def test_short_constant_and_empty_series():
    ys = [np.array([4.0]), np.array([4.0, 5.0]), np.full(30, 7.0), np.zeros(20)]
    _, best, _, settled = FI.fit("dlt", ys, np.arange(4), np.array([1, 2, 30, 20]))
    assert best.tolist() == [0.0, 1.0, 0.0, 0.0] and settled.all()
    assert FI.fit("ets", [], np.zeros(0, int), np.zeros(0, int))[1].shape == (0,)


def test_chunks_of_pairs_give_the_same_fits(monkeypatch):
    ys = [series(k, 80) for k in range(9)]
    args = ("ets", ys, np.arange(9), np.full(9, 80))
    whole = FI.fit(*args)
    monkeypatch.setattr(FI, "RUNS", 3 * FI.N_STARTS)
    parts = FI.fit(*args)
    assert (whole[1] == parts[1]).all() and all((whole[0][p] == parts[0][p]).all() for p in S.PARAMS)


def test_default_forecast_is_fitted_and_sql_replays_its_weights(spark):
    rows = [(f"w{k}", D0 + dt.timedelta(i), float(v)) for k in range(3) for i, v in enumerate(series(k, 120))]
    panel = spark.createDataFrame(rows, "well string, ds date, y double")
    fc = FC.forecast(panel, "y", "ETS", horizon=4, params={"n_bootstrap_draws": 0})
    got = [r.asDict() for r in fc.withColumn("n", F.col("train_end")).select("well", "fold", "step", "n", "yhat", "params").collect()]
    assert all(r["params"]["converged"] in ("true", "false") and set(r["params"]) >= {"alpha", "gamma", "n_bootstrap_draws"} for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE obs (well VARCHAR, t INT, y DOUBLE)")
    con.executemany("INSERT INTO obs VALUES (?, ?, ?)", [(w, (d - D0).days + 1, v) for w, d, v in rows])
    con.execute("CREATE TABLE fits (well VARCHAR, fold INT, n INT, a DOUBLE, g DOUBLE)")
    fits = {(r["well"], r["fold"], r["n"], float(r["params"]["alpha"]), float(r["params"]["gamma"])) for r in got}
    assert len(fits) == 18 and len({x[3:] for x in fits}) > 10  # each well and training part has its own
    con.executemany("INSERT INTO fits VALUES (?, ?, ?, ?, ?)", sorted(fits))
    replay = con.execute("""
        WITH RECURSIVE r AS (
          SELECT f.*, 1 AS t, o.y AS l, [0.0::DOUBLE FOR i IN range(12)] AS s FROM fits f JOIN obs o ON o.well = f.well AND o.t = 1
          UNION ALL
          SELECT r.well, r.fold, r.n, a, g, r.t + 1, l + a * (o.y - l - s[1]), list_append(s[2:12], s[1] + g * (1 - a) * (o.y - l - s[1]))
          FROM r JOIN obs o ON o.well = r.well AND o.t = r.t + 1 WHERE r.t < r.n)
        SELECT well, fold, l, s FROM r WHERE t = n""").fetchall()
    state = {(w, f): (level, season) for w, f, level, season in replay}
    for r in got:
        level, season = state[r["well"], r["fold"]]
        assert math.isclose(r["yhat"], level + season[(r["step"] - 1) % 12], rel_tol=1e-9)


@pytest.mark.parametrize("model", ["DLT", "LGT"])
def test_given_weights_are_held_and_others_fitted(spark, model):
    rows = [("w", D0 + dt.timedelta(i), float(v), float(i % 7)) for i, v in enumerate(series(2, 90))]
    panel = spark.createDataFrame(rows, "well string, ds date, y double, x double")
    fc = FC.forecast(panel, "y", model, ["x"], horizon=3, params={"alpha": 0.25, "n_bootstrap_draws": 0}).filter("part = 'future'").collect()
    assert len(fc) == 3 and all(float(r.params["alpha"]) == 0.25 and "beta" in r.params and math.isfinite(r.yhat) for r in fc)


@pytest.mark.parametrize("n", [1, 5, 6, 7, 61, 100])
@pytest.mark.parametrize("holdout", [None, (0.7, 0.95)])
def test_cuts_are_those_of_the_backtest(spark, n, holdout):
    from boreflow.functions.regress import split_cuts
    from boreflow.operators.backtest import split_bounds

    rows = spark.createDataFrame([(n,)], "n int").select(split_bounds(F.col("n"), 5, holdout)[0].alias("b")).first().b
    assert split_cuts(n, 5, holdout) == [(r.fold, r.train_end, r.test_start, r.test_end) for r in rows]


def test_a_pass_is_cut_to_its_live_rows_and_blocks_change_nothing(monkeypatch):
    ys = [series(k, n) for k, n in enumerate((200, 150, 90, 41, 17, 3))]
    lens = np.array([len(y) for y in ys])
    whole = {kind: FI.fit(kind, ys, np.arange(6), lens) for kind in ("ets", "dlt", "lgt")}
    for kind, (w, best, _, _) in whole.items():
        for k, y in enumerate(ys):
            assert math.isclose(best[k], plain_sse(kind, y, {p: w[p][k] for p in S.PARAMS}), rel_tol=1e-9)
    monkeypatch.setattr(FI, "BLOCK", 5)
    for kind, (w, best, _, _) in whole.items():
        again = FI.fit(kind, ys, np.arange(6), lens)
        assert (again[1] == best).all() and all((again[0][p] == w[p]).all() for p in S.PARAMS)


def test_end_states_are_those_of_the_plain_run():
    ys = [series(k, n) for k, n in enumerate((60, 1, 41, 17, 60))]
    src, lens = np.array([0, 0, 1, 2, 3, 4]), np.array([60, 24, 1, 41, 17, 60])
    for kind in ("ets", "dlt", "lgt"):
        w = {p: np.linspace(0.1, 0.9, 6) for p in S.PARAMS}
        snaps = S.run(kind, ys, np.zeros(6, int), w, src=src, stops=[[(0, int(n), 9)] for n in lens])
        level, trend, season, error = FI.end_states(kind, ys, src, lens, w)
        for r, n in enumerate(lens):
            fc = S._forecast(kind, level[r], trend[r], season[r], int(n), 9, *(w[p][r] for p in ("phi", "xi1", "xi2", "lam")), 12)
            assert (fc == snaps[r][0][3]).all() and error[r] == snaps[r][0][1]
