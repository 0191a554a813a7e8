"""Least squares from Spark-side Gram sums; only the k x k solve runs in Python.

``gram`` turns any grouped set of feature rows into ``X'X``, ``X'y`` and ``y'y`` with plain
``sum`` aggregates (partial aggregation on the map side, so a hot group is pre-summed in
every task before the shuffle). The result is one row per group with flat arrays.
``solve`` is an Arrow-batched pandas UDF that solves a batch of small systems at once with
NumPy: ridge (closed form, penalty relative to each feature's scale), lasso (coordinate
descent on the Gram matrix) or plain least squares, with a per-feature keep mask so several
candidate feature sets share one Gram aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOLVE_T = T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType()),
                        T.StructField("converged", T.BooleanType())])
METHODS = {"ols": 0, "fixed_ridge": 1, "auto_ridge": 1, "ridge": 1, "lasso": 2}


def gram(df: DataFrame, by: Sequence[str], feats: Sequence[Column], ys: Sequence[Column], weight: Column | None = None,
         builder=None, inputs: Sequence[Column] | None = None, prefix: tuple[str, str, int] | None = None) -> DataFrame:
    """Per group: ``n``, ``xtx`` (k*k row-major), ``xty_<t>`` (k) and ``yty_<t>`` for every target t.

    Features and targets are JVM column expressions evaluated in one projection. Each task
    then sums its own rows per group with NumPy (``mapInPandas`` over Arrow batches: a map-side
    partial, one small vector per group and batch), and a ``Summarizer.sum`` aggregate adds the
    partials by group after the shuffle. Rows with a null feature or target are skipped.
    A hot group is therefore pre-summed in every task that holds part of it; only partial
    vectors of ``k*k + T*(k+1) + 1`` doubles cross the shuffle.

    ``builder`` (optional): a NumPy function ``builder(*arrays) -> (m, k) matrix`` that makes the
    same features inside the task from the few ``inputs`` columns, so wide feature sets (e.g. 50
    Fourier terms) need not cross Arrow; ``feats`` then only gives k (and stays the definition
    used for prediction; tests check that both agree).

    ``prefix=(block_col, fold_col, last)``: nested groups. A row of block ``b`` belongs to every
    fold ``b..last`` (expanding folds train on prefixes). Partials are summed per block and each
    small partial vector, not each row, is copied to the folds that contain it; the output is
    keyed by ``fold_col``. ``by`` must then name ``block_col`` among its keys.
    """
    by = list(by)
    k, nt = len(feats), len(ys)
    if builder is not None:
        ins = list(inputs or [])
        staged = df.select(*by, *[c.cast("double").alias(f"_i{j}") for j, c in enumerate(ins)],
                           *[y.cast("double").alias(f"_y{t}") for t, y in enumerate(ys)],
                           (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
        return _gram_staged(staged, by, k, nt, [f"_i{j}" for j in range(len(ins))], builder, prefix)
    staged = df.select(*by, *[f.cast("double").alias(f"_f{i}") for i, f in enumerate(feats)],
                       *[y.cast("double").alias(f"_y{t}") for t, y in enumerate(ys)],
                       (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
    return _gram_staged(staged, by, k, nt, [f"_f{i}" for i in range(k)], None, prefix)


def _gram_staged(staged: DataFrame, by: list[str], k: int, nt: int, fcols: list[str], builder,
                 prefix: tuple[str, str, int] | None = None) -> DataFrame:
    key_fields = [staged.schema[b] for b in by]
    out_schema = T.StructType(key_fields + [T.StructField("_v", T.ArrayType(T.DoubleType()))])
    ycols = [f"_y{t}" for t in range(nt)]

    def partial(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            raw = pdf[fcols + ycols + ["_w"]].to_numpy(dtype=float)
            if builder is not None:
                x = builder(*[raw[:, j] for j in range(len(fcols))])
                vals = np.column_stack([x, raw[:, len(fcols):]])
            else:
                vals = raw
            ok = ~np.isnan(vals).any(axis=1)
            if not ok.all():
                pdf, vals = pdf[ok], vals[ok]
            if pdf.empty:
                continue
            codes, uniq = pd.factorize(pd.MultiIndex.from_frame(pdf[by])) if len(by) > 1 else pd.factorize(pdf[by[0]])
            order = np.argsort(codes, kind="stable")
            bounds = np.flatnonzero(np.diff(codes[order])) + 1
            keys, vecs = [], []
            for grp in np.split(order, bounds):
                x, y, w = vals[grp, :k], vals[grp, k:k + nt], vals[grp, k + nt]
                xw = x * w[:, None]
                parts = [(xw.T @ x).ravel()]
                for t in range(nt):
                    parts += [xw.T @ y[:, t], [float(w @ (y[:, t] * y[:, t]))]]
                parts.append([float(w.sum())])
                keys.append(codes[grp[0]])
                vecs.append(np.concatenate(parts).tolist())
            kdf = pd.DataFrame([uniq[c] if len(by) > 1 else (uniq[c],) for c in keys], columns=by)
            kdf["_v"] = vecs
            yield kdf

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = staged.mapInPandas(partial, out_schema)
    if prefix is not None:
        block, fold, last = prefix
        parts = parts.select(*[b for b in by if b != block],
                             F.explode(F.sequence(F.col(block), F.lit(last))).alias(fold), "_v")
        by = [fold if b == block else b for b in by]
    agg = parts.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("_v"))).alias("_v"))
    v = F.col("_v")
    kk = k * k
    out = [F.col(b) for b in by] + [v[kk + nt * (k + 1)].alias("n"), F.slice(v, 1, kk).alias("xtx")]
    for t in range(nt):
        off = kk + t * (k + 1)
        out += [F.slice(v, off + 1, k).alias(f"xty_{t}"), v[off + k].alias(f"yty_{t}")]
    return agg.select(*out)


LASSO_SWEEPS = 500
NO_TARGET = 1e300  # value of a target that a row cannot have; its group then gets no solution


def _lasso(a: np.ndarray, b: np.ndarray, lam: np.ndarray, pen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent on a stack of Gram matrices (standardised by the diagonal); also which converged."""
    diag = np.einsum("mii->mi", a)
    thr = lam[:, None] * pen * np.sqrt(np.where(diag > 0, diag, 1.0))
    beta, done = np.zeros_like(b), np.zeros(len(b), bool)
    for _ in range(LASSO_SWEEPS):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        old, cur = beta[live].copy(), beta[live]
        for j in range(b.shape[1]):
            d = diag[live, j]
            rho = b[live, j] - np.einsum("mk,mk->m", a[live, j], cur) + d * cur[:, j]
            step = np.sign(rho) * np.maximum(np.abs(rho) - thr[live, j], 0.0)
            cur[:, j] = np.where(d > 0, step / np.where(d > 0, d, 1.0), 0.0)
        beta[live] = cur
        done[live] = np.abs(cur - old).max(axis=1) <= 1e-10 * (1.0 + np.abs(cur).max(axis=1))
    return beta, done


def _solve_stack(a: np.ndarray, b: np.ndarray, lam: np.ndarray, pen: np.ndarray, method: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a stack of systems of one shape, and whether each converged."""
    if method == 2:
        return _lasso(a, b, lam, pen)
    done = np.ones(len(b), bool)
    if method == 1:
        diag = np.einsum("mii->mi", a)
        a = a + np.einsum("mi,ij->mij", lam[:, None] * pen * np.where(diag > 0, diag, 1.0), np.eye(a.shape[1]))
    try:
        return np.linalg.solve(a, b[..., None])[..., 0], done
    except np.linalg.LinAlgError:  # a singular one among them: least squares for each
        return np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b, strict=True)]), done


@F.pandas_udf(SOLVE_T)
def _solve_udf(xtx: pd.Series, xty: pd.Series, yty: pd.Series, keep: pd.Series, pen: pd.Series,
               lam: pd.Series, method: pd.Series) -> pd.DataFrame:
    betas, sses, done = [None] * len(xtx), [None] * len(xtx), [None] * len(xtx)
    alike: dict[tuple, list[int]] = {}
    for i, (a, b, yy, kp, m) in enumerate(zip(xtx, xty, yty, keep, method)):
        if a is None or b is None or yy is None:
            continue
        if not np.abs(b).max() < NO_TARGET / 1e100:  # a target that does not exist for this group
            continue
        alike.setdefault((len(b), np.asarray(kp, bool).tobytes(), int(m)), []).append(i)
    for (k, kp, m), rows in alike.items():
        kept = np.flatnonzero(np.frombuffer(kp, bool))
        a = np.stack([np.asarray(xtx[i], float).reshape(k, k) for i in rows])
        b = np.stack([np.asarray(xty[i], float) for i in rows])
        beta, ok = np.zeros((len(rows), k)), np.ones(len(rows), bool)
        if len(kept):
            weights = np.stack([np.asarray(pen[i], float)[kept] for i in rows])
            strength = np.array([float(lam[i]) for i in rows])
            beta[:, kept], ok = _solve_stack(a[:, kept[:, None], kept], b[:, kept], strength, weights, m)
        sse = yty.iloc[rows].to_numpy(float) - 2.0 * np.einsum("mk,mk->m", beta, b) + np.einsum("mi,mij,mj->m", beta, a, beta)
        for r, i in enumerate(rows):
            betas[i], sses[i], done[i] = beta[r].tolist(), max(float(sse[r]), 0.0), bool(ok[r])
    return pd.DataFrame({"beta": betas, "sse": sses, "converged": done})


def solve(xtx: Column, xty: Column, yty: Column, keep: Column, pen: Column, lam: Column, method: Column) -> Column:
    """Struct ``(beta array<double>, sse double, converged boolean)``; ``sse`` is the in-sample residual sum
    of squares, ``converged`` tells whether a lasso settled within its sweeps. A group with a
    row marked ``NO_TARGET`` gets null.

    ``keep`` (array<boolean>) drops features (their coefficient is 0), ``pen`` (array<double>)
    says which features are penalised, ``method`` is 0 ols, 1 ridge, 2 lasso.
    """
    return _solve_udf(xtx, xty, yty, keep, pen, lam.cast("double"), method.cast("int"))


def dot(beta: Column, feats: Sequence[Column]) -> Column:
    """``sum_i beta[i] * f_i`` as one JVM expression."""
    out = None
    for i, f in enumerate(feats):
        term = beta[i] * f
        out = term if out is None else out + term
    return out


def bool_array(mask: Sequence[bool]) -> Column:
    return F.array(*[F.lit(bool(m)) for m in mask])


def dbl_array(vals: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vals])
