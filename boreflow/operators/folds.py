"""Splits and backtest frames (B1-B4), by row position within each well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY, ORDER, series_window


def _position(df: DataFrame, key: str, order: str) -> DataFrame:
    """0-based position and series length per well (one sort, no extra shuffle)."""
    return df.withColumns(
        {
            "_pos": (F.row_number().over(series_window(key, order)) - 1).cast("int"),
            "_n": F.count(F.lit(1)).over(Window.partitionBy(key)).cast("int"),
        }
    )


def holdout(df: DataFrame, train_frac: float = 0.7, test_from: float = 0.95, key: str = KEY, order: str = ORDER) -> DataFrame:
    """B1: first ``int(n*train_frac)`` rows are train, rows from ``int(n*test_from)`` on are test.

    The rows between are unused and dropped. Adds ``part`` ('train'/'test') and ``pos``.
    """
    staged = _position(df, key, order)
    tr_end = F.floor(F.col("_n") * F.lit(train_frac)).cast("int")
    te_start = F.floor(F.col("_n") * F.lit(test_from)).cast("int")
    part = F.when(F.col("_pos") < tr_end, "train").when(F.col("_pos") >= te_start, "test")
    return (
        staged.withColumn("part", part)
        .filter(F.col("part").isNotNull())
        .withColumnRenamed("_pos", "pos")
        .drop("_n")
    )


def fold_bounds(n: Column, n_splits: int = 5) -> Column:
    """Expanding-window folds for a series of length ``n``, as an array of structs.

    Test size ``s = n div (n_splits+1)``; fold k (0-based) trains on ``[0, n-(n_splits-k)*s)``
    and tests on the next ``s`` rows.
    """
    s = F.floor(n / F.lit(n_splits + 1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_splits - 1)),
        lambda k: F.struct(
            k.alias("fold"),
            (n - (F.lit(n_splits) - k) * s).cast("int").alias("train_end"),
            (n - (F.lit(n_splits) - k) * s + s).cast("int").alias("test_end"),
        ),
    )


def expanding_folds(df: DataFrame, n_splits: int = 5, key: str = KEY, order: str = ORDER) -> DataFrame:
    """B2: every row copied into each fold it belongs to, labelled 'train' or 'test'.

    A row at position p belongs to fold k when ``p < test_end_k``; the copy is a per-row
    ``explode`` over at most ``n_splits`` folds (no join).
    """
    staged = _position(df, key, order)
    b = F.explode(fold_bounds(F.col("_n"), n_splits)).alias("_b")
    out = staged.select("*", b).filter(F.col("_pos") < F.col("_b.test_end"))
    return out.select(
        *[c for c in df.columns],
        F.col("_b.fold").alias("fold"),
        F.when(F.col("_pos") < F.col("_b.train_end"), "train").otherwise("test").alias("part"),
        F.col("_pos").alias("pos"),
    )


def fold_sizes(folds: DataFrame, key: str = KEY) -> DataFrame:
    """Rows per well, fold and part."""
    return folds.groupBy(key, "fold", "part").agg(F.count(F.lit(1)).alias("n"))


def align(actual: DataFrame, forecast: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pair forecast and actual by ``(well, fold, step)``; the inner join keeps the common length."""
    on = on or [KEY, "fold", "step"]
    return actual.join(forecast, on, "inner")
