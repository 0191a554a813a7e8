"""Regression stage of DLT and LGT, one series at a time, as a grouped Arrow aggregate.

A series comes in once: the Gram sums of every training part, the solves of every candidate, residuals and
the regression on the test rows are made from the same arrays, and no row is copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boreflow.functions import linalg as L
from boreflow.functions.gaps import in_order, plain, values_of

PER_FIT = ("fold", "cid", "train_end", "h", "pos", "step", "beta", "r", "ds", "y", "reg")


def split_cuts(n: int, n_splits: int, holdout: tuple[float, float] | None) -> list[tuple[int, int, int, int]]:
    """``backtest.split_bounds`` of a series of ``n`` rows: (fold, train_end, test_start, test_end), final fit last."""
    if holdout is not None:
        return [(0, int(np.floor(n * holdout[0])), int(np.floor(n * holdout[1])), n), (1, n, n, n)]
    size = int(np.floor(n / (n_splits + 1)))
    ends = [n - (n_splits - k) * size for k in range(n_splits)]
    return [*((k, end, end, end + size) for k, end in enumerate(ends)), (n_splits, n, n, n)]


def trend_columns(n: int, train_end: int, regs: Sequence[np.ndarray], used: np.ndarray) -> list[np.ndarray | None]:
    """``smoothing.trend_features`` of the first ``n`` positions; None for a feature no candidate uses."""
    pos = np.arange(n, dtype=float)
    t = pos / max(train_end, 1)
    made = (lambda: np.ones(n), lambda: t, lambda: np.log1p(pos), lambda: 1.0 / (1.0 + np.exp(-10.0 * (t - 0.5))))
    return [f() if u else None for f, u in zip(made, used[:4], strict=True)] + [r[:n] if u else None for r, u in zip(regs, used[4:], strict=True)]


def regression_fits(y: np.ndarray, regs: Sequence[np.ndarray], cands: Sequence, cuts: Sequence[tuple[int, int, int, int]]):
    """(cut, candidate number, coefficients, regression up to the cut's test end) of every fit that has training rows."""
    keep = np.array([c.keep for c in cands], bool)
    pen = np.array([c.pen for c in cands], float)
    used = keep.any(axis=0)
    at = np.flatnonzero(used)
    for cut in cuts:
        _, train_end, _, test_end = cut
        if train_end < 1:
            continue
        cols = trend_columns(max(train_end, test_end), train_end, regs, used)
        x, yt = np.stack([cols[i][:train_end] for i in at]) if len(at) else np.zeros((0, train_end)), y[:train_end]
        a, b = x @ x.T, x @ yt
        if np.isnan(b).any() or np.isnan(a).any() or not len(at):
            ok = ~(np.isnan(x).any(axis=0) | np.isnan(yt))
            x, yt = x[:, ok], yt[ok]
            a, b = x @ x.T, x @ yt
        if not len(yt):
            continue
        if len(b) and not np.abs(b).max() < L.NO_TARGET / 1e100:
            continue
        for cid, c in enumerate(cands):
            kept = keep[cid][at]
            lam = len(used) / max(len(yt), 1.0) if c.auto else float(c.lam)
            beta = np.zeros(len(used))
            if kept.any():
                some = np.flatnonzero(kept)
                beta[at[some]] = L._solve_stack(a[np.ix_(some, some)][None], b[some][None], np.array([lam]), pen[cid][at[some]][None], L.METHODS[c.method])[0][0]
            fitted = np.zeros(len(y[: max(train_end, test_end)]))
            for i in at[kept]:
                fitted = fitted + beta[i] * cols[i]
            yield cut, cid, beta, fitted


def stage1_type(order: T.DataType) -> T.StructType:
    d, i = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
    kinds = {"fold": i, "cid": i, "train_end": i, "h": i, "pos": i, "step": i, "ds": T.ArrayType(T.ArrayType(order))}
    return T.StructType([
        T.StructField("n", T.IntegerType()), T.StructField("end", order), T.StructField("ended", d),
        *[T.StructField(f, kinds.get(f, T.ArrayType(d))) for f in PER_FIT]])


def stage1(order: T.DataType, cands: Sequence, horizon: int, n_splits: int, holdout: tuple[float, float] | None, ahead: int, *fields: Column) -> Column:
    """Aggregate ``stage1_type`` over (order, target, regressors...): ``PER_FIT`` are arrays with one element per fit.

    ``r`` are the residuals of the training part, ``ds``, ``y`` and ``reg`` the dates, targets and regression of
    the test rows, from position ``pos`` and step ``step`` on. The final fit has none of these: its rows lie
    past the end, ``ahead`` days after the date ``end`` with the regressors ``ended`` or a scenario's.
    """
    cands = list(cands)

    def run(*parts):
        ds, target, *given = in_order(parts)
        y = values_of(target.fill_null(np.nan) if target.null_count else target)
        regs, n = [values_of(p) for p in given], len(target)
        cuts = split_cuts(n, n_splits, holdout)
        last = cuts[-1][0]
        out: dict = {f: [] for f in PER_FIT}
        for (fold, train_end, start, end), cid, beta, fitted in regression_fits(y, regs, cands, cuts if horizon > 0 else cuts[:-1]):
            final = fold == last
            place = (n - 1 + ahead, 1) if final else (start, start - train_end + 1)
            test = slice(0, 0) if final else slice(start, end)
            size = test.stop - test.start
            row = (fold, cid, train_end, horizon if final else end - train_end, *place, beta, y[:train_end] - fitted[:train_end],
                   plain(ds.slice(test.start, size)), plain(target.slice(test.start, size)), fitted[test])
            for f, v in zip(PER_FIT, row, strict=True):
                out[f].append(v)
        return {"n": n, "end": ds[-1].as_py(), "ended": np.array([r[-1] for r in regs]), **out}

    return F.arrow_udf(run, stage1_type(order), F.ArrowUDFType.GROUPED_AGG)(*fields)
