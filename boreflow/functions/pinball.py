"""Pooled quantile regression on sliding windows, by reweighted Gram sums.

One window of a series has ``n_input`` values, divided by their mean absolute value, and predicts a day
some steps ahead, divided by the same. The steps ahead fall into classes: the first ``n_out`` steps
have one each, after that a class is twice as long as all before it, so a year needs a dozen. For
every class and quantile a linear model reads the scaled inputs and, of the day it predicts, weekly
and yearly waves, which are known ahead. No prediction is fed back, so far steps have a band of
their own. A long class learns from every window once, at steps that run evenly through the class.

The pinball loss is met by reweighted least squares: a window's weight is q or 1 - q (by the sign of
its error) over the size of that error, from the coefficients of the round before. A round needs
weighted Gram sums only, so tasks add up their own wells and one small matrix per (fold, class,
quantile) is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

QUANTILES = (0.1, 0.5, 0.9)
ROUNDS = 12
FLOOR = (0.3, 1e-2)  # least error size of the first and the last round, in scaled units
WAVES = ((7.0, 2), (365.25, 1))  # (period in days, order)


def known(days: np.ndarray) -> np.ndarray:
    """Waves of the day numbers: the features that are known ahead."""
    cols = [f(2.0 * math.pi * k / period * days) for period, order in WAVES for k in range(1, order + 1) for f in (np.sin, np.cos)]
    return np.stack(cols, axis=-1)


def width(n_input: int) -> int:
    return 1 + n_input + 2 * sum(order for _, order in WAVES)


def classes(n_out: int, longest: int) -> list[tuple[int, int]]:
    """(first, last) step ahead of each class, up to ``longest`` steps."""
    out = [(k, k) for k in range(1, n_out + 1)]
    while out[-1][1] < longest:
        out.append((out[-1][1] + 1, 2 * out[-1][1]))
    return out


def windows(y: np.ndarray, n_input: int) -> tuple[np.ndarray, np.ndarray]:
    """(scaled inputs with a leading 1, scale) of all windows of a series; a window with a gap has scale 0."""
    m = len(y) - n_input
    if m <= 0:
        return np.zeros((0, n_input + 1)), np.zeros(0)
    x = np.lib.stride_tricks.sliding_window_view(y, n_input)[:m]
    scale = np.abs(x).mean(axis=1)
    scale = np.where(np.isnan(scale), 0.0, np.where(scale > 0, scale, 1.0))
    return np.concatenate([np.ones((m, 1)), x / np.where(scale > 0, scale, 1.0)[:, None]], axis=1), scale


def floor_of(number: int) -> float:
    """Least error size of a round, falling geometrically from the first bound to the second."""
    first, last = FLOOR
    return first * (last / first) ** (number / max(ROUNDS - 1, 1))


def partial_sums(wells: Iterable[tuple[np.ndarray, np.ndarray, dict[int, int]]], n_input: int, ahead: list[tuple[int, int]],
                 betas: dict[tuple[int, int, int], np.ndarray] | None, floor: float) -> dict[tuple[int, int, int], np.ndarray]:
    """{(fold, class, quantile index): X'WX, X'Wy and the sum of the weights, flat} over the wells.

    A well is (values, day numbers, {fold: training end}). Without coefficients all weights are 1 and
    only quantile index 0 is filled: the least-squares start that all quantiles share.
    """
    out: dict[tuple[int, int, int], np.ndarray] = {}
    for y, days, folds in wells:
        inputs, scale = windows(y, n_input)
        start = np.arange(len(inputs))
        for c, (lo, hi) in enumerate(ahead):
            at = start + (n_input - 1 + lo) + start % (hi - lo + 1)
            used = np.flatnonzero((at < len(y)) & (scale > 0))
            used = used[np.isfinite(y[at[used]])]
            if not len(used):
                continue
            at = at[used]
            feats = np.concatenate([inputs[used], known(days[at])], axis=1)
            target = y[at] / scale[used]
            for fold, train_end in folds.items():
                mine = at < train_end
                if not mine.any():
                    continue
                x, t = feats[mine], target[mine]
                for j, q in enumerate(QUANTILES if betas is not None else (None,)):
                    if q is None:
                        w = np.ones(len(t))
                    elif (fold, c, j) in betas:
                        r = t - x @ betas[fold, c, j]
                        w = np.where(r < 0, 1.0 - q, q) / np.maximum(np.abs(r), floor)
                    else:
                        continue
                    xw = x * w[:, None]
                    v = np.concatenate([(xw.T @ x).ravel(), xw.T @ t, [w.sum()]])
                    got = out.get((fold, c, j))
                    out[fold, c, j] = v if got is None else got + v
    return out


def solve(sums: np.ndarray, n_input: int, lam: float) -> np.ndarray:
    """Ridge coefficients from flat sums; the intercept is not penalised, so shares stay at their quantile."""
    k = width(n_input)
    gram, xty = sums[: k * k].reshape(k, k), sums[k * k : k * k + k]
    diag = np.diag(gram)
    pen = np.where(np.arange(k) > 0, lam, 0.0) * np.where(diag > 0, diag, 1.0)
    return np.linalg.solve(gram + np.diag(pen + 1e-10 * (1.0 + diag)), xty)


def predict(y: np.ndarray, days: np.ndarray, train_end: int, begin: int, h: int, fold: int, n_input: int, ahead: list[tuple[int, int]],
            betas: dict[tuple[int, int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(median, lower, upper) at the ``h`` positions from ``begin``, all from the last ``n_input`` training values.

    Quantiles of a step are put in order, so they never cross. A context shorter than ``n_input`` is
    padded with its first value. A class without coefficients, for want of history, takes those of the last
    one that has some; with none at all the last value is carried on and there is no band.
    """
    past = y[:train_end][np.isfinite(y[:train_end])]
    last = past[-1] if len(past) else 0.0
    have = [c for c in range(len(ahead)) if (fold, c, 0) in betas]
    if not have:
        return np.full(h, last), np.full(h, np.nan), np.full(h, np.nan)
    ctx = past[-n_input:]
    ctx = np.concatenate([np.full(n_input - len(ctx), ctx[0] if len(ctx) else 0.0), ctx])
    scale = float(np.abs(ctx).mean()) or 1.0
    at = begin + np.arange(h)
    step = np.maximum(at - train_end + 1, 1)  # a forecast that begins on the last training day starts with step 1
    own = np.searchsorted([hi for _, hi in ahead], step)
    own = np.array(have)[np.maximum(np.searchsorted(have, own, side="right") - 1, 0)]
    coef = np.array([[betas[fold, c, j] for j in range(len(QUANTILES))] for c in have])[np.searchsorted(have, own)]
    feats = np.concatenate([np.ones((h, 1)), np.broadcast_to(ctx / scale, (h, n_input)), known(days[at])], axis=1)
    rows = np.sort(np.einsum("sqk,sk->sq", coef, feats) * scale, axis=1)
    return rows[:, 1], rows[:, 0], rows[:, 2]
