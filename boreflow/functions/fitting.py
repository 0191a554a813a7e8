"""Smoothing weights fitted to each series by bounded least squares on the one-step errors.

One batch of series is fitted at once: every row of the NumPy arrays is one (series, training
end) pair, and a pass of the recursion in ``smoothing`` runs all of them together, for as many
parameter points per pair as a step of the search needs. The search is Levenberg-Marquardt inside
a box. The box is the search space of the tuner. Weights live in the unit cube; the derivative of
every one-step error comes from one extra run per weight with that weight moved a little, so the same
code serves all three kinds. A start table (a low-discrepancy sequence, the same for all series)
is evaluated first and the search goes on from each pair's best points; a pair is left alone once
it has settled. Nothing depends on which other series share the batch.

Weights the caller gives are held; the others are fitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boreflow.functions import smoothing as S

# The ranges of the tuner's search spaces.
BOX: dict[str, dict[str, tuple[float, float]]] = {
    "ets": {"alpha": (0.01, 0.99), "gamma": (0.0, 0.5)},
    "dlt": {"alpha": (0.01, 0.9), "beta": (0.0, 0.3), "gamma": (0.0, 0.5), "phi": (0.8, 1.0)},
    "lgt": {"alpha": (0.01, 0.9), "beta": (0.0, 0.3), "gamma": (0.0, 0.5), "xi1": (0.0, 1.0), "xi2": (0.0, 0.05), "lam": (0.1, 0.9)},
}
N_STARTS = 32  # points of the start table
N_BEST = 2  # searches per pair, from its best starting points
MAX_STEPS = 12
MOVE = 1e-4  # step of the numerical derivative, in units of the box
SETTLED = 1e-6  # a search has settled when a step gains less than this share of the error
DAMPINGS = (0.1, 1.0, 10.0)  # tried side by side, times the pair's own damping
RUNS = 8_192  # runs of one pass over the start table, few enough for their states to stay in cache
BLOCK = 16  # time steps whose errors are worked up together
PAIRS = 1_024  # pairs searched together; more are fitted in several passes


def start_table(n: int, dims: int) -> np.ndarray:
    """``n`` points that fill the unit cube evenly (additive recurrence with the generalised golden ratio)."""
    g = 1.5
    for _ in range(60):
        g = (1.0 + g) ** (1.0 / (dims + 1))
    steps = g ** -np.arange(1, dims + 1)
    return (0.5 + np.arange(1, n + 1)[:, None] * steps) % 1.0


def _weights(kind: str, u: np.ndarray, free: list[str], held: dict[str, float]) -> dict[str, np.ndarray]:
    """Parameter arrays of the recursion from points in the unit cube."""
    out = {p: np.full(u.shape[:-1], held.get(p, S.NEUTRAL[p])) for p in S.PARAMS}
    for k, p in enumerate(free):
        lo, hi = BOX[kind][p]
        out[p] = lo + u[..., k] * (hi - lo)
    return out


def _by_time(ys: list[np.ndarray], src: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """One column per pair of series and training end, one row per time."""
    out = np.zeros((len(src), max(1, int(lens.max(initial=0)))))
    for i, (s, n) in enumerate(zip(src, lens, strict=True)):
        out[i, :n] = ys[s][:n]
    return np.ascontiguousarray(out.T)


def _errors(kind: str, y: np.ndarray, cols: np.ndarray, lens: np.ndarray, prm: dict[str, np.ndarray], m: int,
            ends: np.ndarray | None = None):
    """The one-step errors from time 1 on, in blocks ``(times, points, rows)``; a block is overwritten by the next.

    ``y`` holds one series per column, so that a time step is one block of memory; ``cols`` names the series
    of each row, longest first (``lens``), so that the rows still running are the first ones. Errors past a
    row's end are 0, and the arrays are cut to the rows still running as soon as an eighth has ended.
    ``ends`` (like ``slots`` below) takes every row's state after its last value, the level and trend in slot 0.
    """
    shape = prm["alpha"].shape
    # One slot per seasonal term, with room for the level and the trend of the step that term is due at: a step
    # reads those of the slot before, and all three take their share of the error in one operation.
    slots = np.zeros((m, 3, *shape))
    slots[0, 0] = y[0][cols]
    alpha = prm["alpha"]
    shares = np.stack([alpha, prm["beta"], prm["gamma"] * (1.0 - alpha)])
    others = np.stack([prm["phi"], prm["xi1"], prm["xi2"], prm["lam"], 1.0 - alpha, 1.0 - prm["beta"]])
    size, width = int(lens.max(initial=0)), 0
    running = np.searchsorted(-lens, -np.arange(size + 1), side="left").tolist()  # rows longer than t
    add, sub, mul, power, sign = np.add, np.subtract, np.multiply, np.power, np.copysign
    for begin in range(1, size, BLOCK):
        if not width or running[begin] <= width * 7 // 8:
            width = running[begin]
            slots, shares, others = (np.ascontiguousarray(x[..., :width]) for x in (slots, shares, others))
            work, block, at = np.empty((3, len(alpha), width)), np.empty((BLOCK, len(alpha), width)), cols[:width]
            al, be, ri = shares
            ph, x1, x2, la, re, ke = others
            base, tmp, damped = work
            due = [(x, *x) for x in slots]
        errors = block[: min(BLOCK, size - begin)]
        for t, yt, e in zip(range(begin, size), y[begin : begin + BLOCK].take(at, axis=1), errors):
            _, lv, tr, _ = due[(t - 1) % m]
            slot, level, trend, s0 = due[t % m]
            if kind == "dlt":
                mul(ph, tr, trend)
                add(lv, trend, level)
                add(level, s0, e)
                sub(yt, e, e)
                mul(shares, e, work)
                add(slot, work, slot)
            elif kind == "ets":
                add(lv, s0, e)
                sub(yt, e, e)
                mul(al, e, tmp)
                add(lv, tmp, level)
                mul(ri, e, tmp)
                add(s0, tmp, s0)
            elif kind == "lgt":
                np.abs(lv, tmp)
                power(tmp, la, tmp)
                sign(tmp, lv, tmp)
                mul(tmp, x2, tmp)
                mul(x1, tr, base)
                add(base, tmp, base)
                add(lv, base, base)
                add(base, s0, e)
                sub(yt, e, e)
                sub(yt, s0, tmp)
                mul(al, tmp, tmp)
                mul(re, base, base)
                add(tmp, base, tmp)  # the next level
                sub(tmp, lv, damped)
                mul(be, damped, damped)
                mul(ke, tr, base)
                add(damped, base, trend)
                level[:] = tmp
                mul(ri, e, tmp)
                add(s0, tmp, s0)
            else:
                raise ValueError(kind)
            if running[t] < width:
                e[:, running[t] :] = 0.0
            if ends is not None and running[t + 1] < running[t]:
                over = slice(running[t + 1], running[t])
                ends[:, 2, :, over] = slots[:, 2, :, over]
                ends[0, :2, :, over] = slot[:2, :, over]
        yield errors


def end_states(kind: str, ys: list[np.ndarray], src: np.ndarray, lens: np.ndarray, weights: dict[str, np.ndarray], m: int = S.SEASON):
    """Level, trend, seasonal terms and squared one-step errors of every pair after its training part."""
    order = np.argsort(-lens, kind="stable")
    y, prm = _by_time(ys, src[order], lens[order]), {p: v[None, order] for p, v in weights.items()}
    ends, total = np.zeros((m, 3, 1, len(src))), np.zeros((1, len(src)))
    ends[0, 0] = y[0]
    with np.errstate(all="ignore"):
        for e in _errors(kind, y, np.arange(len(src)), lens[order], prm, m, ends):
            e = np.where(np.isfinite(e), e, 0.0)
            _accumulate(total[:, : e.shape[2]], e, e)
    back = np.argsort(order)
    return ends[0, 0, 0, back], ends[0, 1, 0, back], ends[:, 2, 0][:, back].T, total[0, back]


def sse(kind: str, y: np.ndarray, cols: np.ndarray, lens: np.ndarray, prm: dict[str, np.ndarray], m: int = S.SEASON) -> np.ndarray:
    """Squared one-step errors ``(points, rows)``; infinite where a run overflows."""
    total = np.zeros(prm["alpha"].shape)
    with np.errstate(all="ignore"):
        for e in _errors(kind, y, cols, lens, prm, m):
            _accumulate(total[:, : e.shape[2]], e, e)
    return np.where(np.isfinite(total), total, np.inf)


def _linearised(kind: str, y: np.ndarray, cols: np.ndarray, lens: np.ndarray, u: np.ndarray, free: list[str], held: dict[str, float], m: int):
    """J'J and J'e of the one-step errors at ``u`` (rows, weights)."""
    r, p = u.shape
    sign = np.where(u + MOVE <= 1.0, 1.0, -1.0)
    points = np.stack([u, *[u + sign[:, [k]] * MOVE * np.eye(p)[k] for k in range(p)]])
    prm = _weights(kind, points, free, held)
    turn = np.ascontiguousarray(sign.T)
    a, g = np.zeros((p, p, r)), np.zeros((p, r))
    with np.errstate(all="ignore"):
        for e in _errors(kind, y, cols, lens, prm, m):
            live = e.shape[2]
            d = e[:, 1:] - e[:, :1]
            d /= MOVE
            d *= turn[:, :live]
            for k in range(p):
                _accumulate(a[k, k:, :live], d[:, k : k + 1], d[:, k:])
            _accumulate(g[:, :live], d, e[:, :1])
    low = np.tril_indices(p, -1)
    a[low] = a.transpose(1, 0, 2)[low]
    a, g = a.transpose(2, 0, 1), g.T
    return np.nan_to_num(a, posinf=0.0, neginf=0.0), np.nan_to_num(g, posinf=0.0, neginf=0.0)


def _accumulate(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Add the products of the times in their order, so that the sum depends on neither the blocks nor the other rows."""
    if total.size < 2:  # NumPy adds a single column pairwise
        for product in x * y:
            total += product
        return
    parts = np.empty((len(x) + 1, *total.shape))
    parts[0] = total
    np.multiply(x, y, parts[1:])
    np.add.reduce(parts, axis=0, out=total)


def _search(kind: str, y: np.ndarray, cols: np.ndarray, lens: np.ndarray, u: np.ndarray, best: np.ndarray, free: list[str], held: dict[str, float], m: int):
    """Improve every row's point; returns points, their errors, steps taken and which rows settled."""
    r, p = u.shape
    u, best = u.copy(), best.copy()
    damping, steps, settled = np.full(r, 1e-2), np.zeros(r, int), best <= 0.0
    for _ in range(MAX_STEPS):
        on = np.flatnonzero(~settled)
        if not len(on):
            break
        a, g = _linearised(kind, y, cols[on], lens[on], u[on], free, held, m)
        # a weight on its bound whose gradient points outwards stays there
        stuck = ((u[on] <= 0.0) & (g > 0)) | ((u[on] >= 1.0) & (g < 0))
        g = np.where(stuck, 0.0, g)
        a = np.where(stuck[:, :, None] | stuck[:, None, :], 0.0, a)
        scale = np.einsum("rkk->rk", a)
        tried = []
        for factor in DAMPINGS:
            lift = (damping[on] * factor)[:, None] * scale + 1e-12 * (1.0 + scale.max(axis=1, keepdims=True)) + stuck
            move = np.linalg.solve(a + lift[:, :, None] * np.eye(p), -g[..., None])[..., 0]
            tried.append(np.clip(u[on] + move, 0.0, 1.0))
        points = np.stack(tried)
        got = sse(kind, y, cols[on], lens[on], _weights(kind, points, free, held), m)
        pick = got.argmin(axis=0)
        value, point = got[pick, np.arange(len(on))], points[pick, np.arange(len(on))]
        better = value < best[on]
        gain = np.where(better, 1.0 - value / np.maximum(best[on], 1e-300), 0.0)
        u[on[better]], best[on[better]] = point[better], value[better]
        damping[on] = np.where(better, damping[on] * np.array(DAMPINGS)[pick] * 0.3, damping[on] * 100.0)
        steps[on] += 1
        settled[on] = np.where(better, gain < SETTLED, damping[on] > 1e4) | (np.abs(g).max(axis=1) <= 1e-12)
    return u, best, steps, settled


def fit(kind: str, ys: list[np.ndarray], src: np.ndarray, lens: np.ndarray, held: dict[str, float] | None = None, m: int = S.SEASON):
    """Least one-step squared error over the box for every pair of ``src`` (series) and ``lens`` (training end).

    Returns ``(weights {name: array}, sse, steps, settled)``. A pair of fewer than three values,
    or with every weight held, is not searched and counts as settled.
    """
    held = dict(held or {})
    free = [p for p in BOX[kind] if p not in held]
    r = len(src)
    u = np.full((r, len(free)), 0.5)
    steps, settled, best = np.zeros(r, int), np.ones(r, bool), np.zeros(r)
    long = np.flatnonzero(lens >= 3) if free else np.zeros(0, int)
    long = long[np.argsort(-lens[long], kind="stable")]  # alike lengths together: a pass ends with its longest
    table = start_table(N_STARTS, len(free)) if free else np.zeros((0, 0))
    chunk = max(1, RUNS // N_STARTS)
    for k in range(0, len(long), PAIRS):
        rows = long[k : k + PAIRS]
        y, n = _by_time(ys, src[rows], lens[rows]), len(rows)
        start = np.concatenate([
            sse(kind, y, np.arange(n)[i : i + chunk], lens[rows[i : i + chunk]],
                _weights(kind, np.repeat(table[:, None], len(rows[i : i + chunk]), axis=1), free, held), m)
            for i in range(0, n, chunk)], axis=1)
        order = np.argsort(start, axis=0, kind="stable")[:N_BEST]
        # the searches of one pair side by side, so that the rows stay sorted by length
        cols = np.repeat(np.arange(n), N_BEST)
        point, value, used, done = _search(
            kind, y, cols, lens[rows][cols], table[order.T.reshape(-1)], np.take_along_axis(start, order, axis=0).T.reshape(-1), free, held, m)
        first = np.arange(n) * N_BEST + value.reshape(n, N_BEST).argmin(axis=1)
        u[rows], best[rows], settled[rows] = point[first], value[first], done[first]
        steps[rows] = used.reshape(n, N_BEST).sum(axis=1)
    weights = _weights(kind, u, free, held)
    left = np.setdiff1d(np.arange(r), long)
    left = left[np.argsort(-lens[left], kind="stable")]
    if len(left):
        best[left] = sse(kind, _by_time(ys, src[left], lens[left]), np.arange(len(left)), lens[left], {p: v[None, left] for p, v in weights.items()}, m)[0]
    return weights, best, steps, settled


FIT_T = T.ArrayType(T.StructType([
    T.StructField("fold", T.IntegerType()), *[T.StructField(p, T.DoubleType()) for p in S.PARAMS],
    T.StructField("sse", T.DoubleType()), T.StructField("n_fit", T.IntegerType()), T.StructField("steps", T.IntegerType()),
    T.StructField("converged", T.BooleanType()), T.StructField("fc", T.ArrayType(T.DoubleType()))]))


def fit_folds_udf(kind: str, held: dict[str, float] | None = None):
    """Pandas UDF ``(y, cuts) -> array of fits``; ``cuts`` = array of (fold, train_end, h).

    One row is one series; each of its training parts (a prefix of the series) gets weights of its
    own, and its forecast goes ``h`` steps from the end of that part.
    """
    held = dict(held or {})

    @F.pandas_udf(FIT_T)
    def run(y: pd.Series, cuts: pd.Series) -> pd.Series:
        out: list = [[] for _ in range(len(y))]
        ys, where, src, lens, folds, hs = [], [], [], [], [], []
        for i, (values, cl) in enumerate(zip(y, cuts, strict=True)):
            if values is None or not len(values) or cl is None:
                continue
            for c in cl:
                if int(c["train_end"]) >= 1:
                    src.append(len(ys))
                    lens.append(int(c["train_end"]))
                    folds.append(int(c["fold"]))
                    hs.append(int(c["h"]))
            ys.append(np.asarray(values, dtype=float))
            where.append(i)
        if not src:
            return pd.Series(out)
        src_a, lens_a = np.array(src), np.array(lens)
        weights, total, steps, settled = fit(kind, ys, src_a, lens_a, held)
        level, trend, season, error = end_states(kind, ys, src_a, lens_a, weights)
        for r, s in enumerate(src):
            fc = S._forecast(kind, level[r], trend[r], season[r], lens[r], hs[r], *(weights[p][r] for p in ("phi", "xi1", "xi2", "lam")), S.SEASON)
            out[where[s]].append({
                "fold": folds[r], **{p: float(weights[p][r]) for p in S.PARAMS}, "sse": float(error[r]), "n_fit": lens[r] - 1, "steps": int(steps[r]),
                "converged": bool(settled[r]), "fc": fc.tolist()})
        return pd.Series(out)

    return run
