"""M1: exponential smoothing with a level and additive seasonality (no trend).

Error-correction form, one-step forecast ``f_t = l_{t-1} + s_{t-m}``, ``e_t = y_t - f_t``::

    l_t = l_{t-1} + alpha * e_t
    s_t = s_{t-m} + gamma * (1 - alpha) * e_t

Start: ``l_1 = y_1`` and all m seasonal terms 0. The h-step forecast from state t is
``l_t + s_{t-m+1+((h-1) mod m)}``. Smoothing weights come from a candidate grid; per well and
training length the candidate with the least in-sample one-step SSE is the fit. This is a
deterministic least-squares fit, not the posterior of a Bayesian smoother.

Plan: the recursion is a JVM ``aggregate()`` over the well's sorted value array, one row per
(well, candidate). Expanding-window folds train on prefixes of one series, so a single pass
records the state at every fold's training length (and at ``n`` for the final fit) instead of
refitting per fold. Seasonal terms are kept as a queue of m values: the head is the term
for the next step.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY

SEASON = 12


def candidate_array(cands: Iterable[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(g)).alias("gamma")) for a, g in cands])


def default_grid() -> list[tuple[float, float]]:
    return [(a, g) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for g in (0.05, 0.2)]


def ets_states(series: DataFrame, y: str, cands: Iterable[tuple[float, float]], cuts: Column,
               m: int = SEASON, key: str = KEY) -> DataFrame:
    """State after each training length in ``cuts`` (array<int>), for every candidate.

    Returns ``well, alpha, gamma, cut, level, season array<double>, sse`` (one row per
    well x candidate x cut). Extra columns of ``series`` are carried along.
    """
    staged = series.select("*", cuts.alias("_cuts"), F.explode(candidate_array(cands)).alias("_c"))
    alpha, gamma = F.col("_c.alpha"), F.col("_c.gamma")
    g1 = gamma * (F.lit(1.0) - alpha)
    arr = F.col(y)
    zeros = F.array_repeat(F.lit(0.0), m)
    snap_t = "array<struct<cut:int,level:double,season:array<double>,sse:double>>"
    first = F.struct(F.lit(1).alias("cut"), arr[0].alias("level"), zeros.alias("season"), F.lit(0.0).alias("sse"))
    init = F.struct(
        F.lit(1).alias("i"),
        arr[0].alias("l"),
        zeros.alias("s"),
        F.lit(0.0).alias("sse"),
        F.when(F.array_contains("_cuts", 1), F.array(first)).otherwise(F.array().cast(snap_t)).alias("snaps"),
    )

    def step(acc, v):
        e = v - (acc["l"] + acc["s"][0])
        level = acc["l"] + alpha * e
        season = F.concat(F.slice(acc["s"], 2, m - 1), F.array(acc["s"][0] + g1 * e))
        sse = acc["sse"] + e * e
        i = acc["i"] + 1
        snap = F.struct(i.alias("cut"), level.alias("level"), season.alias("season"), sse.alias("sse"))
        snaps = F.when(F.array_contains("_cuts", i), F.concat(acc["snaps"], F.array(snap))).otherwise(acc["snaps"])
        return F.struct(i.alias("i"), level.alias("l"), season.alias("s"), sse.alias("sse"), snaps.alias("snaps"))

    run = F.aggregate(F.slice(arr, 2, F.greatest(F.col("n") - 1, F.lit(0))), init, step)
    keep = list(series.columns)
    out = staged.select(*keep, alpha.alias("alpha"), gamma.alias("gamma"), F.explode(run["snaps"]).alias("_s"))
    return out.select(*keep, "alpha", "gamma", "_s.cut", "_s.level", "_s.season", "_s.sse")


def ets_point(level: Column, season: Column, h: Column, m: int = SEASON) -> Column:
    """h-step-ahead forecast (h >= 1) from a state."""
    return level + F.element_at(season, ((h - 1) % m + 1).cast("int"))


def best_fit(states: DataFrame, by: Iterable[str] = (KEY, "cut")) -> DataFrame:
    """Least in-sample SSE per well and training length (ties: smaller alpha, then gamma)."""
    from boreflow.operators.evaluate import rank_by

    return rank_by(states, "sse", by, tie=("alpha", "gamma"))
