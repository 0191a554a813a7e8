"""Hyper-parameter search as one Spark job over wells x trials.

A search space is a dict ``name -> spec``; specs: ``("cat", [values])``, ``("int", lo, hi)``,
``("float", lo, hi)``, ``("log", lo, hi)`` (log-uniform). ``draw`` makes ``n_trials`` seeded
draws (a small parameter table, the same on every run and machine). Every trial is fitted for
every well at once, scored by RMSE on the hold-out split (train on the first 70 %, test on the
last 5 %), and the best trial per well wins (ties: lower trial number). All wells are tuned,
on their training part only. ``tune_adaptive`` spends fewer fits: its later trials are drawn near
the good ones of the earlier rounds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.functions import parzen
from boreflow.operators import evaluate as E
from boreflow.operators.clean import KEY
from boreflow.plans.forecast import DEFAULTS, USES_REGRESSORS, forecast
from boreflow.plans.models import fourier, ktr, lags, paths, smoothing
from boreflow.session import cut_lineage

HOLDOUT = (0.7, 0.95)
N_TRIALS = 50

# The reference's search spaces (where a knob has a counterpart here), plus the
# smoothing weights and penalty strengths our deterministic fits expose instead of sampler settings.
SPACES: dict[str, dict[str, tuple]] = {
    "DLT": {"global_trend_option": ("cat", ["flat", "linear", "loglinear", "logistic"]),
            "regression_penalty": ("cat", ["fixed_ridge", "lasso", "auto_ridge"]),
            "alpha": ("float", 0.01, 0.9), "beta": ("float", 0.0, 0.3), "gamma": ("float", 0.0, 0.5),
            "phi": ("float", 0.8, 1.0)},
    "LGT": {"regression_penalty": ("cat", ["fixed_ridge", "lasso", "auto_ridge"]),
            "alpha": ("float", 0.01, 0.9), "beta": ("float", 0.0, 0.3), "gamma": ("float", 0.0, 0.5),
            "xi1": ("float", 0.0, 1.0), "xi2": ("float", 0.0, 0.05), "lam": ("float", 0.1, 0.9)},
    "ETS": {"alpha": ("float", 0.01, 0.99), "gamma": ("float", 0.0, 0.5)},
    "KTR": {"lam": ("log", 1e-3, 10.0)},
    "Prophet": {"seasonality_mode": ("cat", ["additive", "multiplicative"]),
                "yearly_seasonality": ("cat", [True, False]), "weekly_seasonality": ("cat", [True, False])},
    "Chronos": {"n_paths": ("cat", [20, 50, 100, 200])},
    "LSTM": {"n_steps": ("int", 1, 5), "n_out": ("cat", [7, 14, 30]), "lam": ("log", 1e-3, 10.0)},
    "TFT": {"n_input": ("cat", [14, 24, 28, 48]), "n_out": ("cat", [7, 14]), "lam": ("log", 1e-3, 10.0)},
    "N-BEATS": {"n_input": ("cat", [14, 24, 28, 48]), "n_out": ("cat", [7, 14]), "lam": ("log", 1e-3, 10.0)},
}


def value(spec: tuple, u: float):
    """The parameter value at place ``u`` of the unit range."""
    if spec[0] == "cat":
        return spec[1][min(int(u * len(spec[1])), len(spec[1]) - 1)]
    if spec[0] == "int":
        return min(int(spec[1] + math.floor(u * (spec[2] - spec[1] + 1))), spec[2])
    if spec[0] == "float":
        return spec[1] + u * (spec[2] - spec[1])
    if spec[0] == "log":
        return math.exp(math.log(spec[1]) + u * (math.log(spec[2]) - math.log(spec[1])))
    raise ValueError(spec)


def draw_points(space: dict[str, tuple], n_trials: int = N_TRIALS, seed: int = 42) -> np.ndarray:
    """``n_trials`` seeded points of the unit cube, one axis per parameter in the order of names."""
    return np.random.default_rng(seed).random((n_trials, len(space)))


def start_points(space: dict[str, tuple], n: int, seed: int) -> np.ndarray:
    """``n`` seeded points, each axis cut into n strata that hold one point each (a Latin hypercube)."""
    rng = np.random.default_rng(seed)
    return np.stack([(rng.permutation(n) + rng.random(n)) / n for _ in space], axis=1)


def trial_at(space: dict[str, tuple], point: Sequence[float]) -> dict:
    return {name: value(space[name], float(u)) for name, u in zip(sorted(space), point, strict=True)}


def draw(space: dict[str, tuple], n_trials: int = N_TRIALS, seed: int = 42) -> list[dict]:
    """``n_trials`` seeded draws from a search space (deterministic)."""
    return [trial_at(space, p) for p in draw_points(space, n_trials, seed)]


def _shared(trials: list[dict], names: Sequence[str]) -> dict[tuple, int]:
    """The first trial of every distinct combination of ``names``: trials alike share one fit."""
    out: dict[tuple, int] = {}
    for i, t in enumerate(trials):
        out.setdefault(tuple(t[n] for n in names), i)
    return out


def _trial_of(column: Column, first: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(first.items()) for x in kv])[column]


def trial_forecasts(panel: DataFrame, target: str, model: str, trials: list[dict], regressors: Sequence[str] = (),
                    horizon: int = 0, n_splits: int = 5, holdout: tuple[float, float] | None = HOLDOUT,
                    scenario: tuple[str, float] | None = None) -> DataFrame:
    """Forecasts of every distinct trial for every well, with an integer ``trial`` column."""
    regs = list(regressors) if model in USES_REGRESSORS else []
    common = {"horizon": horizon, "n_splits": n_splits, "holdout": holdout}
    if model in ("ETS", "DLT", "LGT"):
        kind = model.lower()
        if kind == "ets":
            st1, grid = None, [dict({k: t[k] for k in smoothing.GRID_KEYS if k in t}, trial=i) for i, t in enumerate(trials)]
        else:
            combos = sorted({(t.get("global_trend_option", "none"), t["regression_penalty"]) for t in trials})
            st1 = []
            for tr, pen in combos:
                st1 += smoothing.stage1_candidates(kind, regs, [tr] if tr != "none" else ["linear"], [pen])
            index = {c: i for i, c in enumerate(combos)}
            grid = [dict({k: t[k] for k in smoothing.GRID_KEYS if k in t}, trial=i,
                         cid=index[(t.get("global_trend_option", "none"), t["regression_penalty"])]) for i, t in enumerate(trials)]
        fc = smoothing.smoothing_forecast(panel, target, kind, regs, st1, grid, scenario=scenario, **common)
        return fc.withColumn("trial", F.col("params")["trial"].cast("int"))
    if model == "Prophet":
        names = ("seasonality_mode", "yearly_seasonality", "weekly_seasonality")
        first = _shared(trials, names)
        fc = fourier.fourier_trend(panel, target, cands=fourier.candidates(sorted(first)), **common)
        key = F.concat_ws("|", *[F.col("params")[n] for n in names])
        return fc.withColumn("trial", _trial_of(key, {"|".join(str(x).lower() if isinstance(x, bool) else x for x in c): i for c, i in first.items()}))
    if model == "KTR":
        first = _shared(trials, ("lam",))
        fc = ktr.ktr(panel, target, regs, cands=ktr.candidates(regs, [c[0] for c in sorted(first)]), scenario=scenario, **common)
        return fc.withColumn("trial", _trial_of(F.col("params")["lam"], {repr(float(c[0])): i for c, i in first.items()}))
    outs = None
    if model == "Chronos":
        for (n,), i in sorted(_shared(trials, ("n_paths",)).items()):
            fc = paths.sample_paths(panel, target, n_paths=n, **common).withColumn("trial", F.lit(i))
            outs = fc if outs is None else outs.unionByName(fc)
        return outs
    # Window learners: one Gram pass per window shape solves all its strengths.
    width = (lambda t: t["n_steps"] * 7) if model == "LSTM" else (lambda t: t["n_input"])
    for n_input, n_out in sorted({(width(t), t["n_out"]) for t in trials}):
        lams: dict[str, int] = {}
        for i, t in enumerate(trials):
            if (width(t), t["n_out"]) == (n_input, n_out):
                lams.setdefault(repr(float(t["lam"])), i)
        fc = lags.lag_forecast(panel, target, n_input=n_input, n_out=n_out, mode="direct" if model == "LSTM" else "pooled",
                               lam=[float(x) for x in sorted(lams)], **common)
        fc = fc.withColumn("trial", _trial_of(F.col("params")["lam"], lams)).withColumn("model", F.lit(model))
        outs = fc if outs is None else outs.unionByName(fc)
    return outs


def tune(panel: DataFrame, target: str, model: str, n_trials: int = N_TRIALS, seed: int = 42, regressors: Sequence[str] = (),
         key: str = KEY) -> DataFrame:
    """E5: best trial per well by hold-out RMSE: ``well, model, trial, params, n, rmse, mae, mape``.

    Pass the panel with the regressors masked per well (``forecast.mask_regressors``) to tune the
    model that ``run`` fits. Trials alike share one fit; ties go to the lower trial number and a
    forecast without values (not applicable to the well) never wins. ``params`` holds the trial's
    drawn values over the model's defaults, all as strings. Every well of the panel has a row: where
    no trial could be scored (its hold-out is empty or no forecast applies), ``trial`` and the metrics
    are null, n is 0 and ``params`` are the defaults.
    """
    trials = draw(SPACES[model], n_trials, seed)
    fc = trial_forecasts(panel, target, model, trials, regressors).filter(F.col("part") == "test")
    m = E.metrics(fc, by=(key, "trial"))
    maps = F.array(*[params_map({**DEFAULTS[model], **t}) for t in trials])
    return _every_well(panel, _best_trial(m.withColumn("params", maps[F.col("trial")]), key), model, key)


def _best_trial(scored: DataFrame, key: str) -> DataFrame:
    """The trial of the least RMSE per well; ties go to the lower number, a trial without a score never wins."""
    s = scored.filter(F.col("rmse").isNotNull() & ~F.isnan("rmse"))
    return s.groupBy(key).agg(F.min_by(F.struct("trial", "params", "n", "rmse", "mae", "mape"), F.struct("rmse", "trial")).alias("b")).select(key, "b.*")


def _every_well(panel: DataFrame, best: DataFrame, model: str, key: str) -> DataFrame:
    """One row per well of the panel; a well without a scored trial has trial null and the model's defaults."""
    wells = panel.select(key).distinct()
    return wells.join(best, key, "left").select(
        key, F.lit(model).alias("model"), "trial", F.coalesce("params", params_map(DEFAULTS[model])).alias("params"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), "rmse", "mae", "mape")


def params_map(params: dict) -> Column:
    text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in params.items()}
    return F.create_map(*[F.lit(x) for kv in sorted(text.items()) for x in kv])


def _typed(model: str, text: dict[str, str]) -> dict:
    """A trial from a result's ``params``: the parameters of the search space, as their types."""
    out = {}
    for name, spec in SPACES[model].items():
        raw = text.get(name, DEFAULTS[model].get(name))
        if spec[0] == "cat":
            shown = {(str(v).lower() if isinstance(v, bool) else str(v)): v for v in spec[1]}
            out[name] = shown[raw] if raw in shown else type(spec[1][0])(raw)
        else:
            out[name] = int(raw) if spec[0] == "int" else float(raw)
    return out


def stage1_combos(model: str) -> list[tuple[str, str]]:
    """(global trend, penalty) of every regression stage that a model's space knows, in a fixed order."""
    space = SPACES[model]
    trends = space["global_trend_option"][1] if "global_trend_option" in space else ["none"]
    return sorted((t, p) for t in trends for p in space["regression_penalty"][1]) if "regression_penalty" in space else []


def _weights_grid(model: str, params: Column) -> Column:
    """A well's own one-point grid from the weights (and regression stage) in its ``params``."""
    combos = stage1_combos(model)
    cid = F.lit(-1)
    if combos:
        name = F.concat_ws("|", F.coalesce(params["global_trend_option"], F.lit("none")) if combos[0][0] != "none" else F.lit("none"), params["regression_penalty"])
        cid = _trial_of(name, {"|".join(c): i for i, c in enumerate(combos)})
    return F.array(smoothing.grid_point(F.lit(0), cid, {k: params[k].cast("double") for k in SPACES[model] if k in smoothing.GRID_KEYS}))


def _own_weights(panel: DataFrame, target: str, model: str, grids: DataFrame, regressors: Sequence[str], key: str, **common) -> DataFrame:
    """Smoothing forecasts where each well has its own grid (``well, grid``)."""
    st1 = []
    for trend, penalty in stage1_combos(model):
        st1 += smoothing.stage1_candidates(model.lower(), regressors, [trend if trend != "none" else "linear"], [penalty])
    return smoothing.smoothing_forecast(panel, target, model.lower(), regressors, st1 or None, grids=grids, key=key, **common)


def forecast_tuned(panel: DataFrame, target: str, model: str, tuned: DataFrame, n_trials: int | None = None, seed: int | None = None,
                   regressors: Sequence[str] = (), horizon: int = 30, n_splits: int = 5,
                   scenario: tuple[str, float] | None = None, key: str = KEY) -> DataFrame:
    """Backtest + future forecast of every well with its own tuned parameters (``well, trial, params``).

    ``tuned`` is what ``tune`` or ``tune_adaptive`` returned. ETS, DLT and LGT take each well's own weights
    in one job; for the others the distinct parameter sets that some well chose are fitted (as many
    rows as tuning had trials, at most, reach the driver) and each well keeps the rows of its own.
    A well without a scored trial is forecast with the model's defaults; no well of ``tuned`` is lost.
    The parameters are read from ``tuned``; ``n_trials`` and ``seed`` are no longer needed and are ignored.
    """
    tuned = cut_lineage(tuned.select(key, "trial", F.col("params").alias("_tuned")))
    common = dict(horizon=horizon, n_splits=n_splits, scenario=scenario)
    if model in ("ETS", "DLT", "LGT"):
        scored = tuned.filter("trial is not null")
        fc = _own_weights(panel, target, model, scored.select(key, _weights_grid(model, F.col("_tuned")).alias("grid")), regressors, key, **common)
        out = fc.join(scored, key).withColumn("params", F.col("_tuned")).withColumn("model", F.lit(model)).drop("_tuned")
        rest = tuned.filter("trial is null")
        if rest.limit(1).count():
            plain = forecast(panel.join(rest.select(key), key, "left_semi"), target, model, regressors, params={"n_bootstrap_draws": 0}, **common)
            out = out.unionByName(plain.withColumn("trial", F.lit(None).cast("int")))
        return out
    names = sorted(SPACES[model])
    chosen = tuned.withColumn("_set", F.concat_ws("|", *[F.coalesce(F.col("_tuned")[n], F.lit("")) for n in names]))
    sets = {r._set: _typed(model, r.p) for r in chosen.groupBy("_set").agg(F.min(F.map_entries("_tuned")).alias("p")).select("_set", F.map_from_entries("p").alias("p")).collect()}
    order = sorted(sets)
    fc = trial_forecasts(panel, target, model, [sets[x] for x in order], regressors, horizon, n_splits, None, scenario)
    # trials alike in what the model reads share one fit, under the first of their numbers
    first = {x: _first_alike(model, [sets[y] for y in order], i) for i, x in enumerate(order)}
    mine = chosen.withColumn("_fit", _trial_of(F.col("_set"), first))
    out = fc.withColumnRenamed("trial", "_fit").join(mine, [key, "_fit"])
    return out.withColumn("params", F.col("_tuned")).withColumn("model", F.lit(model)).drop("_tuned", "_set", "_fit")


def _first_alike(model: str, trials: list[dict], i: int) -> int:
    shown = [tuple(repr(float(t[n])) if isinstance(t[n], float) else t[n] for n in sorted(t)) for t in trials]
    return shown.index(shown[i])


def finite_space(space: dict[str, tuple]) -> list[dict] | None:
    """Every trial of a space of choices only; None where it has a range."""
    if any(spec[0] != "cat" for spec in space.values()):
        return None
    names = sorted(space)
    return [dict(zip(names, v, strict=True)) for v in product(*[space[n][1] for n in names])]


def tune_adaptive(panel: DataFrame, target: str, model: str, n_start: int = 10, rounds: int = 5, per_round: int = 3, seed: int = 42,
                  regressors: Sequence[str] = (), key: str = KEY) -> DataFrame:
    """E5 by a search that learns from earlier trials; the same columns as ``tune`` and ``fits``.

    ``n_start`` seeded points, the same for all wells and spread over every parameter, are scored on the hold-out split; then ``rounds``
    rounds follow, each with ``per_round`` trials drawn by tree-structured Parzen densities of the good
    and the bad trials so far. The scored trials of all rounds are kept in one table in the checkpoint
    folder. ETS, DLT and LGT learn per well: a task reads the trials of a well (``n_start + rounds *
    per_round`` at most) and proposes its next ones, so every well's weights are its own. The other models
    share one table of trials among all wells, whose pooled or wide fits serve every well at once;
    a trial counts there by the mean logarithm of its RMSE over the wells. A space of choices
    only is tried out whole instead. ``fits`` counts a well's scored trials. Every well has a
    row, as in ``tune``. Deterministic: seeds come from ``seed``, the round and the well's name.
    """
    space = SPACES[model]
    if model in ("ETS", "DLT", "LGT"):
        scored = _search_per_well(panel, target, model, n_start, rounds, per_round, seed, regressors, key)
    else:
        scored = _search_shared(panel, target, model, n_start, rounds, per_round, seed, regressors, key)
    best = _every_well(panel, _best_trial(scored, key), model, key)
    fits = scored.filter(F.col("rmse").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("fits"))
    return best.join(fits, key, "left").withColumn("fits", F.coalesce("fits", F.lit(0)).cast("long"))


def choices(space: dict[str, tuple]) -> list[int]:
    return [len(space[n][1]) if space[n][0] == "cat" else 0 for n in sorted(space)]


def _score(fc: DataFrame, key: str) -> DataFrame:
    return E.metrics(fc.filter(F.col("part") == "test"), by=(key, "trial"))


def proposer(model: str, n: int, seed: int, number: int):
    """Pandas UDF ``(well, points, rmse) -> next points`` of one round."""
    axes = choices(SPACES[model])

    @F.pandas_udf("array<array<double>>")
    def run(well: pd.Series, points: pd.Series, rmse: pd.Series) -> pd.Series:
        out = []
        for w, p, s in zip(well, points, rmse, strict=True):
            scores = [float("nan") if x is None else float(x) for x in s]
            out.append(parzen.propose(axes, np.array([list(x) for x in p], float), scores, n, (seed, number, zlib.crc32(str(w).encode()))).tolist())
        return pd.Series(out)

    return run


def _points_grid(model: str, points: Column, first: int) -> Column:
    """Grid of a well's proposed points: trial numbers from ``first`` on."""
    space = SPACES[model]
    names = sorted(space)
    combos = stage1_combos(model)

    def one(p, i):
        def axis(name):
            return p[names.index(name)]

        def choice(name):
            values = space[name][1]
            return F.array(*map(F.lit, values))[F.least((axis(name) * len(values)).cast("int"), F.lit(len(values) - 1))]

        cid = F.lit(-1)
        if combos:
            label = F.concat_ws("|", choice("global_trend_option") if "global_trend_option" in space else F.lit("none"), choice("regression_penalty"))
            cid = (F.array_position(F.array(*[F.lit("|".join(c)) for c in combos]), label) - 1).cast("int")
        weights = {n: F.lit(space[n][1]) + axis(n) * F.lit(space[n][2] - space[n][1]) for n in names if n in smoothing.GRID_KEYS}
        return smoothing.grid_point(i + F.lit(first), cid, weights)

    return F.transform(points, one)


def _search_per_well(panel: DataFrame, target: str, model: str, n_start: int, rounds: int, per_round: int, seed: int,
                     regressors: Sequence[str], key: str) -> DataFrame:
    """(well, trial, params, n, rmse, mae, mape) of all trials, each well's own after the first round."""
    space = SPACES[model]
    combos = stage1_combos(model)
    common = dict(horizon=0, n_splits=5, holdout=HOLDOUT)
    wells = panel.select(key).distinct()
    start = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in start_points(space, n_start, seed)])
    asked = cut_lineage(wells.select(key, start.alias("points")))
    state = None
    for number in range(rounds + 1):
        base = 0 if number == 0 else n_start + (number - 1) * per_round
        grids = asked.select(key, _points_grid(model, F.col("points"), base).alias("grid"))
        fc = _own_weights(panel, target, model, grids, regressors, key, **common)
        got = _score(fc.withColumn("trial", F.col("params")["trial"].cast("int")), key)
        tried = asked.select(key, F.posexplode("points").alias("i", "point")).select(key, (F.col("i") + base).cast("int").alias("trial"), "point")
        new = tried.join(got, [key, "trial"], "left")
        state = cut_lineage(new if state is None else state.unionByName(new))
        if number < rounds:
            past = state.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("trial", "point", "rmse"))).alias("t"))
            ask = proposer(model, per_round, seed, number + 1)
            asked = cut_lineage(past.select(key, ask(F.col(key), F.col("t.point"), F.col("t.rmse")).alias("points")))
    grid = _points_grid(model, F.array("point"), 0)[0]
    told = F.create_map(*[x for n in sorted(space) if n in smoothing.GRID_KEYS for x in (F.lit(n), grid[n].cast("string"))])
    if combos:
        kind = F.array(*[params_map({k: v for k, v in (("global_trend_option", t), ("regression_penalty", p)) if v != "none"}) for t, p in combos])
        told = F.map_concat(told, kind[grid["only_cid"]])
    return state.withColumn("params", F.map_concat(F.map_filter(params_map(DEFAULTS[model]), lambda k, _: ~F.array_contains(F.map_keys(told), k)), told)).drop("point")


def _search_shared(panel: DataFrame, target: str, model: str, n_start: int, rounds: int, per_round: int, seed: int,
                   regressors: Sequence[str], key: str) -> DataFrame:
    """(well, trial, params, n, rmse, mae, mape) of all trials, the same ones for all wells."""
    space = SPACES[model]
    every = finite_space(space)
    points = start_points(space, n_start, seed)
    trials = every if every is not None else [trial_at(space, p) for p in points]
    state = None
    for number in range(1 if every is not None else rounds + 1):
        base = 0 if number == 0 else len(trials) - per_round
        maps = F.array(*[params_map({**DEFAULTS[model], **t}) for t in trials[base:]])
        got = _score(trial_forecasts(panel, target, model, trials[base:], regressors), key)
        got = got.withColumn("params", maps[F.col("trial")]).withColumn("trial", (F.col("trial") + base).cast("int"))
        state = cut_lineage(got if state is None else state.unionByName(got))
        if every is None and number < rounds:
            # one number per trial: at most n_start + rounds * per_round rows reach the driver
            mean = {r.trial: r.s for r in state.filter("rmse > 0").groupBy("trial").agg(F.avg(F.log("rmse")).alias("s")).collect()}
            scores = [mean.get(i, mean.get(_first_alike(model, trials, i), float("nan"))) for i in range(len(trials))]
            new = parzen.propose(choices(space), points, scores, per_round, (seed, number + 1))
            points = np.concatenate([points, new])
            trials = trials + [trial_at(space, p) for p in new]
    return state
