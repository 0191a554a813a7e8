"""Windows to arrays (W1-W4): supervised windows, encoder tail, decoder rows.

All windows are ``partitionBy(well).orderBy(ds)`` frames with a fixed row width, so a window
array holds at most ``n_input + n_out`` values no matter how long or hot a well is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY, ORDER, series_window


def supervised(df: DataFrame, target: str, n_input: int, n_out: int = 7, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Sliding windows ``x`` = ``n_input`` values, ``y`` = the next ``n_out`` values.

    One row per full window: ``(well, start_idx, ds_end, x array<double>, y array<double>)``;
    ``start_idx`` is the 0-based position of the window's first value and ``ds_end`` the date
    of its last input value (the target dates follow it).
    """
    w = series_window(key, order)
    xw = w.rowsBetween(0, n_input - 1)
    yw = w.rowsBetween(n_input, n_input + n_out - 1)
    v = F.col(target).cast("double")
    out = df.select(
        key,
        (F.row_number().over(w) - 1).cast("int").alias("start_idx"),
        F.last(order).over(xw).alias("ds_end"),
        F.collect_list(v).over(xw).alias("x"),
        F.collect_list(v).over(yw).alias("y"),
    )
    return out.filter((F.size("x") == n_input) & (F.size("y") == n_out))


def encoder_tail(df: DataFrame, length: int | None = None, key: str = KEY, idx: str = "time_idx",
                 fallback: int = 24) -> DataFrame:
    """The last ``length`` rows of every series (``time_idx > max - length``; default 24)."""
    length = length or fallback
    mx = F.max(idx).over(Window.partitionBy(key))
    return df.withColumn("_mx", mx).filter(F.col(idx) > F.col("_mx") - F.lit(length)).drop("_mx")


def decoder_rows(df: DataFrame, horizon: int, key: str = KEY, order: str = ORDER, idx: str = "time_idx") -> DataFrame:
    """The last row of every series repeated ``horizon`` times with advancing index and date.

    The last row is found by ``max_by`` per well (partial aggregation, no sort of the series).
    """
    cols = [c for c in df.columns if c not in (key,)]
    last = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(idx)).alias("_l")).select(key, "_l.*")
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h")
    out = last.select("*", step)
    return out.withColumns(
        {idx: (F.col(idx) + F.col("_h")).cast("int"), order: F.date_add(order, F.col("_h"))}
    ).drop("_h")


def prediction_frame(df: DataFrame, length: int | None, horizon: int, key: str = KEY, order: str = ORDER,
                     idx: str = "time_idx") -> DataFrame:
    """Encoder tail + decoder rows, then ``ds`` dropped (the pooled models' input)."""
    enc = encoder_tail(df, length, key, idx)
    dec = decoder_rows(df, horizon, key, order, idx)
    return enc.unionByName(dec).drop(order)
