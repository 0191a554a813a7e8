"""Adaptive proposals for a search: tree-structured Parzen densities in the unit cube.

Trials are points of the unit cube, one axis per parameter. The best share of them gives a density of
good points, the others one of bad points, axis by axis: a mixture of truncated normals around the
points and one wide component for a range, smoothed counts for a choice among values. Candidates
are drawn from the good density, and the one where good outweighs bad the most is proposed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

GOOD = 0.15  # share of the trials that count as good
CANDIDATES = 24  # drawn for each proposal
_NORMAL = NormalDist()


def split(scores: Sequence[float]) -> tuple[list[int], list[int]]:
    """Indices of good and bad trials: least scores first, ties by number, missing scores last."""
    order = sorted(range(len(scores)), key=lambda i: (not math.isfinite(scores[i]), scores[i] if math.isfinite(scores[i]) else 0.0, i))
    n = max(1, math.ceil(GOOD * len(order)))
    return order[:n], order[n:]


def kernels(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, widths, masses inside [0, 1]) of the components: one per point and a wide one.

    A component is as wide as the larger gap to its neighbours, the ends of the range included.
    """
    x = np.sort(points)
    padded = np.concatenate([[0.0], x, [1.0]])
    gaps = np.diff(padded)
    width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1.0 / (len(x) + 2.0), 1.0) if len(x) else x
    centre, width = np.append(x, 0.5), np.append(width, 1.0)
    mass = np.array([_NORMAL.cdf((1.0 - c) / w) - _NORMAL.cdf(-c / w) for c, w in zip(centre, width, strict=True)])
    return centre, width, mass


def log_density(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    centre, width, mass = kernels(points)
    z = (x[:, None] - centre) / width
    return np.log(np.mean(np.exp(-0.5 * z * z) / (math.sqrt(2.0 * math.pi) * width * mass), axis=1))


def log_counts(points: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    chosen = np.minimum((points * k).astype(int), k - 1)
    return np.log((np.bincount(chosen, minlength=k) + 1.0) / (len(points) + k))[np.minimum((x * k).astype(int), k - 1)]


def propose(choices: Sequence[int], points: np.ndarray, scores: Sequence[float], n: int, seed: Sequence[int]) -> np.ndarray:
    """``n`` new points from the trials so far (rows of ``points`` with their ``scores``, lower is better).

    ``choices[j]`` is the number of values of a choice on axis j, or 0 for a range. The result
    depends on the arguments alone.
    """
    rng = np.random.default_rng(list(seed))
    good, bad = split(scores)
    out = np.zeros((n, len(choices)))
    for i in range(n):
        ratio = np.zeros(CANDIDATES)
        drawn = np.zeros((CANDIDATES, len(choices)))
        for j, k in enumerate(choices):
            u, v = rng.random(CANDIDATES), rng.random(CANDIDATES)
            g, b = points[good, j], points[bad, j]
            if k:
                weights = np.exp(log_counts(g, (np.arange(k) + 0.5) / k, k))
                index = np.minimum(np.searchsorted(np.cumsum(weights), u, side="right"), k - 1)
                drawn[:, j] = (index + 0.5) / k
                ratio += log_counts(g, drawn[:, j], k) - log_counts(b, drawn[:, j], k)
            else:
                centre, width, mass = kernels(g)
                part = np.minimum((u * len(centre)).astype(int), len(centre) - 1)
                for c, p in enumerate(part.tolist()):
                    low = _NORMAL.cdf(-centre[p] / width[p])
                    at = min(max(low + v[c] * mass[p], 1e-12), 1.0 - 1e-12)
                    drawn[c, j] = min(max(centre[p] + width[p] * _NORMAL.inv_cdf(at), 0.0), 1.0)
                ratio += log_density(g, drawn[:, j]) - log_density(b, drawn[:, j])
        out[i] = drawn[int(ratio.argmax())]
    return out
