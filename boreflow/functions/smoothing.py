"""Exponential-smoothing recursions, vectorised over a batch of series (Arrow pandas UDF).

One UDF row is one (well, fold, candidate) training series. The recursion runs over time in
a Python loop, but every step is one NumPy operation across all rows of the Arrow batch, so
the cost is ``max length x ops`` per batch, not per series. Spark partitions the rows; each
row holds one well's training series (one value per day, bounded by the calendar span).

Kinds (error-correction forms; ``m`` = season length, ``s0`` = the seasonal term due now):

* ``ets`` : level + additive season. ``f = l + s0``; ``l += a e``; ``s0' = s0 + g (1-a) e``.
* ``dlt`` : damped local trend + season. ``f = l + phi b + s0``; ``l' = l + phi b + a e``;
  ``b' = phi b + beta e``; season as ets. h-step: ``l + (phi + ... + phi^h) b + s``.
* ``lgt`` : level, local trend and global power trend. ``f = l + xi1 b + xi2 g(l) + s0`` with
  ``g(l) = sign(l)|l|^lam``; ``l' = a (y - s0) + (1-a)(l + xi1 b + xi2 g(l))``,
  ``b' = beta (l' - l) + (1-beta) b``; season ``s0' = s0 + gam (1-a) e``. h-step rolls the level.

Start: ``l = y_0``, ``b = 0``, seasons 0; the first value is not scored. Output per row: the
one-step in-sample SSE, the number of scored steps and the forecast for steps ``1..h``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEASON = 12
NEUTRAL = {"alpha": 0.3, "beta": 0.0, "gamma": 0.0, "phi": 1.0, "xi1": 1.0, "xi2": 0.0, "lam": 0.5}  # weights not given
PARAMS = tuple(NEUTRAL)
OUT_T = T.StructType([
    T.StructField("sse", T.DoubleType()), T.StructField("n_fit", T.IntegerType()),
    T.StructField("fc", T.ArrayType(T.DoubleType())),
])


def _g(level: np.ndarray, lam: np.ndarray) -> np.ndarray:
    return np.sign(level) * np.abs(level) ** lam


def _forecast(kind, level, trend, season, used, h, phi, xi1, xi2, lam, m):
    """h-step forecasts from a state reached after ``used`` observations."""
    steps = np.arange(1, h + 1)
    s = season[(used - 1 + steps) % m]
    if kind == "ets":
        return level + s
    if kind == "dlt":
        damp = np.cumsum(phi ** steps) if h else np.zeros(0)
        return level + damp * trend + s
    out, lv, drift, power = [], float(level), float(xi1 * trend), float(lam)
    for _ in range(h):
        lv += drift + xi2 * math.copysign(abs(lv) ** power, lv)
        out.append(lv)
    return np.array(out) + s


class State:
    """Level, trend and seasonal terms of many runs, started at their first values."""

    def __init__(self, first: np.ndarray, m: int = SEASON):
        self.level, self.trend, self.m = first.copy(), np.zeros(len(first)), m
        self.season, self.rows = np.zeros((len(first), m)), np.arange(len(first))

    def step(self, kind: str, t: int, y: np.ndarray, prm: dict[str, np.ndarray], live: np.ndarray) -> np.ndarray:
        """Take the values of time ``t`` into every live run; returns the one-step errors of all runs."""
        level, trend, a, gam = self.level, self.trend, prm["alpha"], prm["gamma"]
        si = t % self.m  # position of the seasonal term due at step t (start at 1 -> slot 1)
        s0 = self.season[self.rows, si]
        if kind == "ets":
            e = y - (level + s0)
            nl, nb = level + a * e, trend
        elif kind == "dlt":
            base = level + prm["phi"] * trend
            e = y - (base + s0)
            nl, nb = base + a * e, prm["phi"] * trend + prm["beta"] * e
        elif kind == "lgt":
            base = level + (prm["xi1"] * trend + prm["xi2"] * _g(level, prm["lam"]))
            e = y - (base + s0)
            nl = a * (y - s0) + (1.0 - a) * base
            nb = prm["beta"] * (nl - level) + (1.0 - prm["beta"]) * trend
        else:
            raise ValueError(kind)
        self.level = np.where(live, nl, level)
        self.trend = np.where(live, nb, trend)
        self.season[self.rows, si] = np.where(live, s0 + gam * (1.0 - a) * e, s0)
        return e


def run(kind: str, ys: list[np.ndarray], horizons: np.ndarray, prm: dict[str, np.ndarray], m: int = SEASON,
        src: np.ndarray | None = None, stops: list[list[tuple[int, int, int]]] | None = None):
    """Run one kind over a batch: returns (sse, n_fit, list of forecast arrays).

    ``src[i]`` names the series of run ``i`` (default: run i uses series i), so many parameter
    points share one copy of a series; ``horizons`` and ``prm`` are per run.

    ``stops[i]`` (optional) lists ``(tag, used, h)`` snapshots for run ``i``: the state after the
    first ``used`` observations and its ``h``-step forecast. Expanding folds train on prefixes
    of one series, so one pass serves every fold. With ``stops`` the return value is, per run, a
    list of ``(tag, sse, n_fit, forecast)``.
    """
    src = np.arange(len(ys)) if src is None else np.asarray(src)
    r = len(src)
    slens = np.array([len(y) for y in ys])
    lens = slens[src] if r else np.zeros(0, dtype=int)
    tmax = int(slens.max()) if len(ys) else 0
    mat = np.zeros((len(ys), max(tmax, 1)))
    for i, y in enumerate(ys):
        mat[i, : len(y)] = y
    prm = {p: prm.get(p, np.full(r, v)) for p, v in NEUTRAL.items()}
    phi, xi1, xi2, lam = prm["phi"], prm["xi1"], prm["xi2"], prm["lam"]
    st = State(mat[src, 0], m)
    sse = np.zeros(r)
    snaps: list[list] | None = None
    at: dict[int, list[tuple[int, int, int]]] = {}
    if stops is not None:
        snaps = [[] for _ in range(r)]
        for i, lst in enumerate(stops):
            for tag, used, h in lst:
                at.setdefault(int(used), []).append((i, tag, int(h)))

    def snapshot(used: int) -> None:
        for i, tag, h in at.get(used, ()):
            snaps[i].append((tag, float(sse[i]), max(used - 1, 0), _forecast(
                kind, st.level[i], st.trend[i], st.season[i].copy(), used, h, phi[i], xi1[i], xi2[i], lam[i], m)))

    if snaps is not None:
        snapshot(1)
    for t in range(1, tmax):
        live = t < lens
        if not live.any():
            break
        e = st.step(kind, t, mat[src, t], prm, live)
        e = np.where(np.isfinite(e), e, 0.0)
        sse = np.where(live, sse + e * e, sse)
        if snaps is not None:
            snapshot(t + 1)
    fcs = [_forecast(kind, st.level[i], st.trend[i], st.season[i], int(lens[i]), int(horizons[i]),
                     phi[i], xi1[i], xi2[i], lam[i], m) for i in range(r)]
    if snaps is not None:
        return snaps
    return sse, np.maximum(lens - 1, 0), fcs


GRID_T = T.ArrayType(T.StructType([T.StructField("gid", T.IntegerType())] + OUT_T.fields))


@F.pandas_udf(GRID_T)
def smooth_grid_udf(kind: pd.Series, y: pd.Series, h: pd.Series, grid: pd.Series) -> pd.Series:
    """One row per series; ``grid`` is an array of parameter structs (gid + PARAMS).

    The series crosses Arrow once; the kernel runs every (series, grid point) pair of the
    batch in one vectorised recursion, in chunks that bound the working set.
    """
    n = len(y)
    out: list = [[] for _ in range(n)]
    kinds = kind.to_numpy()
    for k in pd.unique(kinds):
        idx = [i for i in np.flatnonzero(kinds == k) if y.iloc[i] is not None and len(y.iloc[i]) > 0]
        chunk: list[int] = []
        budget = 0
        for pos, i in enumerate(idx):
            chunk.append(i)
            budget += len(grid.iloc[i]) if grid.iloc[i] is not None else 0
            if budget >= 20000 or pos == len(idx) - 1:
                _run_chunk(str(k), chunk, y, h, grid, out)
                chunk, budget = [], 0
    return pd.Series(out)


def _run_chunk(kind: str, rows: list[int], y: pd.Series, h: pd.Series, grid: pd.Series, out: list) -> None:
    ys = [np.asarray(y.iloc[i], dtype=float) for i in rows]
    src, gids, hs, prm = [], [], [], {p: [] for p in PARAMS}
    for j, i in enumerate(rows):
        for g in (grid.iloc[i] if grid.iloc[i] is not None else []):
            src.append(j)
            gids.append(int(g["gid"]))
            hs.append(int(h.iloc[i]))
            for p in PARAMS:
                prm[p].append(float(g[p]))
    if not src:
        return
    sse, nfit, fcs = run(kind, ys, np.array(hs), {p: np.array(v) for p, v in prm.items()}, src=np.array(src))
    for c, j in enumerate(src):
        out[rows[j]].append({"gid": gids[c], "sse": float(sse[c]), "n_fit": int(nfit[c]), "fc": fcs[c].tolist()})


STOPS_T = T.ArrayType(T.StructType([
    T.StructField("gid", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("sse", T.DoubleType()),
    T.StructField("n_fit", T.IntegerType()), T.StructField("fc", T.ArrayType(T.DoubleType()))]))


@F.pandas_udf(STOPS_T)
def smooth_folds_udf(kind: pd.Series, y: pd.Series, cuts: pd.Series, grid: pd.Series) -> pd.Series:
    """One row per whole series; ``cuts`` = array of (fold, train_end, h). Every grid point runs
    the series once and reports each fold's state at its training end (prefix snapshots)."""
    out: list = [[] for _ in range(len(y))]
    kinds = kind.to_numpy()
    for k in pd.unique(kinds):
        idx = [i for i in np.flatnonzero(kinds == k) if y.iloc[i] is not None and len(y.iloc[i]) > 0]
        for start in range(0, len(idx), 200):
            rows = idx[start:start + 200]
            ys = [np.asarray(y.iloc[i], dtype=float) for i in rows]
            src, gids, stops, prm = [], [], [], {p: [] for p in PARAMS}
            for j, i in enumerate(rows):
                cl = [(int(c["fold"]), int(c["train_end"]), int(c["h"])) for c in cuts.iloc[i] if int(c["train_end"]) >= 1]
                for g in (grid.iloc[i] if grid.iloc[i] is not None else []):
                    src.append(j)
                    gids.append(int(g["gid"]))
                    stops.append(cl)
                    for p in PARAMS:
                        prm[p].append(float(g[p]))
            if not src:
                continue
            snaps = run(str(k), ys, np.zeros(len(src), dtype=int), {p: np.array(v) for p, v in prm.items()},
                        src=np.array(src), stops=stops)
            for c, j in enumerate(src):
                for fold, sse, nfit, fc in snaps[c]:
                    out[rows[j]].append({"gid": gids[c], "fold": fold, "sse": sse, "n_fit": nfit, "fc": fc.tolist()})
    return pd.Series(out)
