"""Residual stacks on sliding windows: trend, season and lag blocks, each fitted on what the one before left.

A window of ``n_input`` values, divided by their mean absolute value, passes through the blocks in turn.
A block has two outputs, both linear in its input: the backcast, which is taken off the window before
the next block sees it, and the forecast, which is taken off the target.

* trend: a polynomial of degree 2 is fitted to the window and taken off; its three coefficients forecast.
* season: weekly waves of the calendar are fitted to the rest and taken off; each wave's coefficient times
  the wave's value on the predicted day forecasts.
* lags: what is left of the window, and the yearly waves of the predicted day, forecast.

The weights from coefficients to forecast are shared by all wells, one set per fold and class of steps
ahead (``pinball.classes``). A block's weights come from one pooled Gram pass over the residual targets
of the blocks before it. No prediction is fed back.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

from boreflow.functions.pinball import windows

DEGREE = 2
WEEKLY = 3
BLOCKS = ("trend", "season", "lags")
Weights = dict[tuple[int, int, int], np.ndarray]  # (fold, class, block) -> weights


def weekly(days: np.ndarray) -> np.ndarray:
    angle = days[..., None] * (2.0 * math.pi * np.arange(1, WEEKLY + 1) / 7.0)
    return np.concatenate([np.sin(angle), np.cos(angle)], axis=-1)


def yearly(days: np.ndarray) -> np.ndarray:
    angle = days * (2.0 * math.pi / 365.25)
    return np.stack([np.sin(angle), np.cos(angle)], axis=-1)


def polynomial(n_input: int) -> np.ndarray:
    t = np.linspace(-1.0, 1.0, n_input) if n_input > 1 else np.zeros(1)
    return t[:, None] ** np.arange(DEGREE + 1)


def decompose(x: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend coefficients, wave coefficients, rest) of windows (rows) that end just before the day numbers ``days``.

    The weekly waves are those of each window's own days; fitting them to whole windows of any phase is
    the same small system turned by the phase, so it is solved once per phase.
    """
    n_input = x.shape[1]
    p = polynomial(n_input)
    trend = x @ np.linalg.pinv(p).T
    rest = x - trend @ p.T
    waves = np.zeros((len(x), 2 * WEEKLY))
    phase = np.mod(days.astype(np.int64), 7)
    for k in np.unique(phase):
        mine = phase == k
        s = weekly(np.arange(k - n_input, k, dtype=float))
        waves[mine] = rest[mine] @ np.linalg.pinv(s, rcond=1e-6).T
        rest[mine] -= waves[mine] @ s.T
    return trend, waves, rest


def block_features(block: int, trend: np.ndarray, waves: np.ndarray, rest: np.ndarray, target_days: np.ndarray) -> np.ndarray:
    if block == 0:
        return trend
    if block == 1:
        return waves * weekly(target_days)
    return np.concatenate([np.ones((len(rest), 1)), rest, yearly(target_days)], axis=1)


def partial_sums(wells: Iterable[tuple[np.ndarray, np.ndarray, dict[int, int]]], n_input: int, ahead: list[tuple[int, int]],
                 block: int, weights: Weights) -> Weights:
    """{(fold, class, block): X'X and X'r, flat} of one block over the wells, r the residual of the blocks before."""
    out: Weights = {}
    for y, days, folds in wells:
        inputs, scale = windows(y, n_input)
        if not len(inputs):
            continue
        start = np.arange(len(inputs))
        trend, waves, rest = decompose(inputs[:, 1:], days[start + n_input])
        for c, (lo, hi) in enumerate(ahead):
            at = start + (n_input - 1 + lo) + start % (hi - lo + 1)
            used = np.flatnonzero((at < len(y)) & (scale > 0))
            used = used[np.isfinite(y[at[used]])]
            at = at[used]
            feats = [block_features(b, trend[used], waves[used], rest[used], days[at]) for b in range(block + 1)]
            target = y[at] / scale[used]
            for fold, train_end in folds.items():
                mine = at < train_end
                if not mine.any() or any((fold, c, b) not in weights for b in range(block)):
                    continue
                left = target[mine] - sum((feats[b][mine] @ weights[fold, c, b] for b in range(block)), np.zeros(int(mine.sum())))
                x = feats[block][mine]
                v = np.concatenate([(x.T @ x).ravel(), x.T @ left])
                got = out.get((fold, c, block))
                out[fold, c, block] = v if got is None else got + v
    return out


def solve(sums: np.ndarray, lam: float) -> np.ndarray:
    """Ridge weights of a block from flat sums."""
    k = int((math.isqrt(1 + 4 * len(sums)) - 1) // 2)
    gram, xty = sums[: k * k].reshape(k, k), sums[k * k :]
    diag = np.diag(gram)
    return np.linalg.solve(gram + np.diag(lam * diag + 1e-9 * (1.0 + diag.max())), xty)


def predict(y: np.ndarray, days: np.ndarray, train_end: int, begin: int, h: int, fold: int, n_input: int, ahead: list[tuple[int, int]],
            weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(forecast, contributions (h, blocks)) at the ``h`` positions from ``begin``, from the last training values.

    A short context is padded with its first value; a class without weights takes the last one with some;
    without any the last value is carried on.
    """
    past = y[:train_end][np.isfinite(y[:train_end])]
    last = past[-1] if len(past) else 0.0
    have = [c for c in range(len(ahead)) if all((fold, c, b) in weights for b in range(len(BLOCKS)))]
    if not have or not h:
        return np.full(h, last), np.zeros((h, len(BLOCKS)))
    ctx = past[-n_input:]
    ctx = np.concatenate([np.full(n_input - len(ctx), ctx[0] if len(ctx) else 0.0), ctx])
    scale = float(np.abs(ctx).mean()) or 1.0
    trend, waves, rest = decompose(ctx[None, :] / scale, np.array([days[train_end - 1] + 1]))
    at = begin + np.arange(h)
    own = np.searchsorted([hi for _, hi in ahead], np.maximum(at - train_end + 1, 1))
    own = np.array(have)[np.maximum(np.searchsorted(have, own, side="right") - 1, 0)]
    parts = np.zeros((h, len(BLOCKS)))
    for b in range(len(BLOCKS)):
        feats = block_features(b, *(np.broadcast_to(z, (h, z.shape[1])) for z in (trend, waves, rest)), days[at])
        parts[:, b] = scale * np.einsum("hk,hk->h", feats, np.array([weights[fold, c, b] for c in own]))
    return parts.sum(axis=1), parts
