"""Backtest frame for row-wise models: every history row copied into each fold it belongs to,
plus the future rows of the final fit, in one DataFrame.

Folds 0..K-1 are the expanding-window folds (B2). Fold K is the final fit on the whole series;
its rows past the end are the horizon (``part = 'future'``), dated by H1 and carrying the
scenario regressors of H2/H3. Per row: ``pos`` (0-based position in the well), ``train_end``
(first position not trained on) and ``step`` (1-based step after ``train_end``, null on
training rows). The copy is a per-row ``explode`` over at most K+1 folds; no join of the
history with itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY, ORDER, series_window
from boreflow.operators.folds import fold_bounds
from boreflow.operators.scenario import ramp_value

N_SPLITS = 5


def split_bounds(n, n_splits: int = N_SPLITS, holdout: tuple[float, float] | None = None):
    """Array of ``(fold, train_end, test_start, test_end)`` per well, final fit last.

    Expanding folds (B2) by default; ``holdout=(0.7, 0.95)`` gives the single split of B1
    (train on the first 70 %, test on the last 5 %, the rows between unused).
    """
    if holdout is None:
        folds = F.transform(fold_bounds(n, n_splits), lambda b: F.struct(
            b["fold"].alias("fold"), b["train_end"].alias("train_end"), b["train_end"].alias("test_start"),
            b["test_end"].alias("test_end")))
        k = n_splits
    else:
        tr = F.floor(n * F.lit(holdout[0])).cast("int")
        te = F.floor(n * F.lit(holdout[1])).cast("int")
        folds = F.array(F.struct(F.lit(0).alias("fold"), tr.alias("train_end"), te.alias("test_start"), n.alias("test_end")))
        k = 1
    final = F.struct(F.lit(k).alias("fold"), n.alias("train_end"), n.alias("test_start"), n.alias("test_end"))
    return F.concat(folds, F.array(final)), k


def backtest_rows(df: DataFrame, target: str, regressors: Iterable[str] = (), n_splits: int = N_SPLITS,
                  horizon: int = 30, scenario: tuple[str, float] | None = None, include_last: bool = False,
                  holdout: tuple[float, float] | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """``well, ds, fold, part, pos, train_end, step, y, <regressors>``; the last fold is the final fit."""
    regs = list(regressors)
    w = series_window(key, order)
    staged = df.select(
        key, order, F.col(target).cast("double").alias("y"),
        *[F.coalesce(F.col(r), F.lit(0.0)).alias(r) for r in regs],  # a parameter the well does not have
        (F.row_number().over(w) - 1).cast("int").alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).cast("int").alias("_n"),
    )
    bounds, k = split_bounds(F.col("_n"), n_splits, holdout)
    hist = staged.select("*", F.explode(bounds).alias("_b")).filter(
        (F.col("pos") < F.col("_b.train_end")) | ((F.col("pos") >= F.col("_b.test_start")) & (F.col("pos") < F.col("_b.test_end"))))
    hist = hist.select(
        key, order, "y", *regs, "pos",
        F.col("_b.fold").alias("fold"), F.col("_b.train_end").alias("train_end"),
        F.when(F.col("pos") < F.col("_b.train_end"), "train").otherwise("test").alias("part"),
        F.when(F.col("pos") >= F.col("_b.train_end"), F.col("pos") - F.col("_b.train_end") + 1).cast("int").alias("step"),
    )
    if horizon <= 0:
        return hist.filter(F.col("fold") < k)  # no future rows: the final fit is not needed
    # Future rows (H1-H3) from each well's last row of the same windowed frame: its date, its
    # position and its regressor values (carried forward), with the scenario ramp on one of them.
    param, delta = scenario if scenario else (None, 0.0)
    start = 0 if include_last else 1
    last = staged.filter(F.col("pos") == F.col("_n") - 1).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ramped = {param: ramp_value(F.col(param), delta, F.col("step"), horizon)} if param in regs else {}
    fut = last.withColumns(ramped).select(
        key, F.date_add(order, F.col("step") - 1 + start).alias(order), F.lit(None).cast("double").alias("y"), *regs,
        (F.col("_n") - 2 + F.col("step") + start).cast("int").alias("pos"),
        F.lit(k).alias("fold"), F.col("_n").alias("train_end"), F.lit("future").alias("part"), F.col("step").cast("int"),
    )
    return hist.unionByName(fut)


def last_value_forecast(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Baseline: every test / future step of a fold predicts the last training value.

    One window pass: ``max_by(y, pos)`` over the fold's training rows, as a window partitioned
    by ``(well, fold)`` (the rows are already clustered by ``well``, so no shuffle and no self
    join). Used as the yardstick a model must beat and to exercise the B4/E/U operators.
    """
    train = F.col("part") == "train"
    last = F.max_by(F.when(train, F.col("y")), F.when(train, F.col("pos"))).over(Window.partitionBy(key, "fold"))
    return rows.withColumn("yhat", last).filter(~train).withColumn("model", F.lit("last_value"))
