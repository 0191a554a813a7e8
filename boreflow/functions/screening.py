"""Autocorrelation, Pearson and Spearman of one series at a time, as a grouped Arrow aggregate.

Nulls are left out as SQL's aggregates do: a pair of values counts where both are known, a spread
where its own value is, and in the ranks nulls come first and tie with each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boreflow.functions.gaps import in_order, known_of, values_of

SCREEN_T = T.StructType([
    T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("acf_max", "r", "rho")]])


def centred(v: np.ndarray) -> np.ndarray:
    """Values less their mean; those of a constant are exactly 0."""
    if not len(v) or v.min() == v.max():
        return v - v[:1]
    return v - v.mean()


def largest_acf(v: np.ndarray, known: np.ndarray | None, lags: int) -> float | None:
    """Largest autocorrelation of lag 1 to ``lags``; None where there is none."""
    if known is None:
        c = centred(v)
    else:
        c = np.zeros(len(v))
        c[known] = centred(v[known])
    whole = float(c @ c)
    if whole == 0.0 or not len(c):
        return None
    found = []
    for k in range(1, min(lags, len(c) - 1) + 1):
        if known is None or (known[k:] & known[:-k]).any():
            found.append(float(c[k:] @ c[:-k]) / whole)
    return float(np.max(found)) if found else None


def ranks(v: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Average ranks, nulls first; NaN is the largest value."""
    if known is not None:
        out, none = np.empty(len(v)), len(v) - int(known.sum())
        out[~known] = 1.0 + (none - 1) / 2.0
        out[known] = none + ranks(v[known], None)
        return out
    order = np.argsort(v)
    s = v[order]
    new = s[1:] != s[:-1]
    if len(s) and np.isnan(s[-1]):
        new &= ~np.isnan(s[:-1])  # equal as well
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    ties = np.diff(np.concatenate([first, [len(s)]]))
    out = np.empty(len(v))
    out[order] = np.repeat(first + 1 + (ties - 1) / 2.0, ties)
    return out


def pearson(x: np.ndarray, y: np.ndarray, knows: np.ndarray | None = None, known: np.ndarray | None = None) -> float | None:
    """Population covariance over the product of the standard deviations; None for a constant."""
    xs, ys = (x if knows is None else x[knows]), (y if known is None else y[known])
    if knows is not None or known is not None:
        both = (True if knows is None else knows) & (True if known is None else known)
        x, y = x[both], y[both]
    if not len(x):
        return None
    cx, cy = centred(xs), centred(ys)
    spread = float(np.sqrt(cx @ cx / len(cx)) * np.sqrt(cy @ cy / len(cy)))
    if spread == 0.0:
        return None
    if len(x) != len(xs):
        cx = centred(x)
    if len(y) != len(ys):
        cy = centred(y)
    return float(cx @ cy / len(x)) / spread


def screened(lags: int, *fields: Column) -> Column:
    """Aggregate ``SCREEN_T`` over the fields (order, target, regressors...): the row count, and arrays with one element per regressor."""

    def run(*parts):
        parts = in_order(parts)
        values, known = [values_of(p) for p in parts[1:]], [known_of(p) for p in parts[1:]]
        with np.errstate(all="ignore"):
            places = [ranks(v, k) for v, k in zip(values, known, strict=True)]
            found = [(largest_acf(v, k, lags), pearson(v, values[0], k, known[0]), pearson(place, places[0]))
                     for v, k, place in zip(values[1:], known[1:], places[1:], strict=True)]
        acf, r, rho = (list(x) for x in zip(*found, strict=True))
        return {"n": len(parts[0]), "acf_max": acf, "r": r, "rho": rho}

    return F.arrow_udf(run, SCREEN_T, F.ArrowUDFType.GROUPED_AGG)(*fields)
