"""Lag-window learners: M6 direct multi-output, M7 recursive rollout, M8 pooled across wells.

These stand in for the sequence networks: the supervised windows of W1 (``n_input`` values in,
``n_out`` out) are regressed with ridge, one coefficient vector per output step, from Gram sums
over the windows of each fold's training part. M6/M7 fit per (well, fold); M8 shares one set of
coefficients across all wells per fold, on windows scaled by their own input mean, so a well
with little history borrows strength from the others. The Gram of M8 groups by fold only:
partial sums in every task keep that safe however many windows a fold has.

Forecasting starts from the last ``n_input`` training values of a fold (the whole series for the
final fit) and rolls forward in blocks of ``n_out`` steps (M7: blocks of one step with the
step-1 model), each block fed by the previous predictions: one NumPy kernel rolls all rows of an
Arrow batch, a block at a time. Band: normal, from the root mean in-sample error of the step-1 model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.session import apply_recommended_conf, reuse

from boreflow.operators.backtest import backtest_rows, split_bounds
from boreflow.operators.clean import KEY
from boreflow.operators.windows import supervised
from boreflow.plans.models import common as M
from boreflow.plans.series import series_arrays

ROLL_ROWS = 2000  # rows rolled together; bounds the copies of coefficients in memory
N_INPUT = 14  # 2 sub-sequences x 7 days
N_OUT = 7


def _fold_windows(panel: DataFrame, target: str, n_input: int, n_out: int, n_splits: int,
                  holdout: tuple[float, float] | None, key: str) -> tuple[DataFrame, int]:
    """Windows with their block: the first fold whose training part holds the whole window.

    Expanding folds are nested, so a window of block b trains folds b..last; the Gram is summed
    per block and only the small partial sums are copied to the later folds (no 6x copy of the
    windows). Returns the windows and the last fold index.
    """
    win = supervised(panel, target, n_input, n_out, key)
    # A well of n values has n - n_input - n_out + 1 windows, so their number gives n.
    n = (F.count(F.lit(1)).over(Window.partitionBy(key)) + (n_input + n_out - 1)).cast("int")
    win = win.withColumn("_n", n)
    bounds, k = split_bounds(F.col("_n"), n_splits, holdout)
    end = F.col("start_idx") + F.lit(n_input + n_out)
    first = F.get(F.filter(bounds, lambda b: end <= b["train_end"]), F.lit(0))["fold"]
    staged = win.select(key, first.alias("block"), F.lit("train").alias("part"), "x", "y")
    return staged.filter(F.col("block").isNotNull()), k


def _scale(c: Column) -> Column:
    """Window scale: mean absolute input value (1 when it is 0)."""
    m = F.aggregate(c, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size(c)
    return F.when(m > 0, m).otherwise(F.lit(1.0))


def roll(ctx: np.ndarray, betas: np.ndarray, blocks: int) -> np.ndarray:
    """Predictions of all rows (rows, blocks * outputs), one block at a time, each fed with the last inputs.

    ``ctx`` is (rows, n_input), ``betas`` (rows, outputs, 1 + n_input); a block is predicted on the
    context divided by its mean absolute value.
    """
    ctx, out = ctx.copy(), []
    for _ in range(blocks):
        sc = np.abs(ctx).mean(axis=1, keepdims=True)
        sc[~(sc > 0)] = 1.0
        now = sc * (betas[:, :, 0] + np.einsum("rok,rk->ro", betas[:, :, 1:], ctx / sc))
        out.append(now)
        ctx = np.concatenate([ctx, now], axis=1)[:, -ctx.shape[1]:]
    return np.concatenate(out, axis=1)


def rollout_udf(block: int):
    """Pandas UDF ``(context, coefficients, steps) -> predictions``: null where a row has no coefficients."""

    @F.pandas_udf("array<double>")
    def run(ctx: pd.Series, betas: pd.Series, h: pd.Series) -> pd.Series:
        out: list = [None] * len(ctx)
        rows = [i for i, b in enumerate(betas) if b is not None]
        for k in range(0, len(rows), ROLL_ROWS):
            mine = rows[k : k + ROLL_ROWS]
            x = np.stack([np.asarray(ctx.iloc[i], float) for i in mine])
            b = np.stack([[np.asarray(o, float) for o in betas.iloc[i][:block]] for i in mine])
            blocks = [max(-(-int(h.iloc[i]) // block), 1) for i in mine]
            fc = roll(x, b, max(blocks))
            for r, i in enumerate(mine):
                out[i] = fc[r, : blocks[r] * block].tolist()
        return pd.Series(out)

    return run


def lag_forecast(panel: DataFrame, target: str, horizon: int = 30, n_input: int = N_INPUT, n_out: int = N_OUT,
                 mode: str = "direct", lam: float | list[float] = 0.1, n_splits: int = 5,
                 holdout: tuple[float, float] | None = None, include_last: bool = False, key: str = KEY) -> DataFrame:
    """``mode``: ``direct`` (M6), ``recursive`` (M7) or ``pooled`` (M8).

    ``lam`` may be a list: every penalty strength is solved from the same Gram pass and
    forecast side by side (one ``params`` map per strength).
    """
    apply_recommended_conf(panel.sparkSession)
    panel = reuse(panel)
    if mode not in ("direct", "recursive", "pooled"):
        raise ValueError(mode)
    wins, last = _fold_windows(panel, target, n_input, n_out, n_splits, holdout, key)
    sc = _scale(F.col("x"))
    if mode == "pooled":
        feats = [F.lit(1.0)] + [F.col("x")[i] / sc for i in range(n_input)]
        ys = [F.col("y")[s] / sc for s in range(n_out)]
        by = ["block"]
    else:
        feats = [F.lit(1.0)] + [F.col("x")[i] / sc for i in range(n_input)]
        ys = [F.col("y")[s] / sc for s in range(n_out)]
        by = [key, "block"]
    lams = [float(x) for x in (lam if isinstance(lam, (list, tuple)) else [lam])]
    cands = [M.Candidate({"lam": repr(lm)}, [True] * (n_input + 1), [0.0] + [1.0] * n_input, lm, "ridge", s)
             for lm in lams for s in range(n_out)]
    sol = M.fit(wins, feats, ys, cands, by=by, prefix=("block", "fold", last)).withColumn("lam", F.col("params")["lam"])
    by = [("fold" if b == "block" else b) for b in by]
    coef = sol.groupBy(*by, "lam").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tgt", "beta"))), lambda t: t["beta"]).alias("betas"),
        F.max_by(F.sqrt(F.col("sse") / F.col("n")), F.struct(F.lit(0) - F.col("tgt"))).alias("rel_sd"),
    )
    block = 1 if mode == "recursive" else n_out
    rows = backtest_rows(panel, target, [], n_splits, horizon, None, include_last, holdout, key)
    pred = rows.filter(F.col("part") != "train")
    steps = pred.groupBy(key, "fold", "train_end").agg(F.max("step").alias("h"))
    arrs = series_arrays(panel, [target], key).select(key, F.col(target).alias("_arr"))
    ctx = steps.join(arrs, key).select(
        key, "fold", "h", F.slice("_arr", F.greatest(F.col("train_end") - F.lit(n_input) + 1, F.lit(1)), F.lit(n_input)).alias("ctx"))
    # Shorter contexts are padded on the left with their first value; where a fold has no training
    # window at all (no coefficients) the last value is carried forward.
    first = F.coalesce(F.get("ctx", F.lit(0)), F.lit(0.0))
    ctx = ctx.withColumn("ctx", F.concat(F.array_repeat(first, F.lit(n_input) - F.size("ctx")), F.col("ctx")))
    ctx = ctx.withColumn("lam", F.explode(F.array(*[F.lit(repr(x)) for x in lams])))
    if mode == "pooled":  # one row per fold and strength: bounded by these two parameters
        coef = F.broadcast(coef)
    fc = ctx.join(coef, [*by, "lam"], "left").select(
        key, "fold", "lam", rollout_udf(block)(F.col("ctx"), F.col("betas"), F.col("h")).alias("fc"),
        F.element_at("ctx", -1).alias("last"), (F.col("rel_sd") * _scale(F.col("ctx"))).alias("sd"))
    out = pred.join(fc, [key, "fold"])
    yhat = F.coalesce(F.get("fc", F.col("step") - 1), F.col("last"))
    name = {"direct": "LSTM", "recursive": "LSTM-rollout", "pooled": "N-BEATS"}[mode]
    params = {"n_input": str(n_input), "n_out": str(n_out), "mode": mode}
    band_lo = F.lit(None).cast("double") if mode == "pooled" else yhat - F.lit(1.96) * F.col("sd")
    band_hi = F.lit(None).cast("double") if mode == "pooled" else yhat + F.lit(1.96) * F.col("sd")
    return out.select(
        key, "fold", "part", "ds", "pos", "train_end", "step", "y",
        F.map_concat(M.param_map(params), F.create_map(F.lit("lam"), F.col("lam"))).alias("params"),
        yhat.alias("yhat"), band_lo.alias("yhat_lower"), band_hi.alias("yhat_upper"), F.lit(name).alias("model"))
