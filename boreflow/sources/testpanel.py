"""Panels derived from the given TPC-H-style tables (no well data ships with the tests).

* main panel   : ``well = l_returnflag || l_linestatus`` (6 wells), one row per ship day.
* scale panel  : ``well = l_suppkey`` (1,000 wells at sf0.1), same parameters; used by the bench.
* short panel  : ``events`` by ``event_type`` and hour.

The raw panel is laid on a daily grid per well (first to last day of that well), the way a
sheet lists every date: days without data become blank (null) cells, and real zero
readings (``disc``/``tax``) stay zeros, so the cleaning operators have both kinds of gap.
The heavy step is the ``(well, ds)`` aggregate: it runs with map-side partial aggregation, so
a well holding a third of all raw rows is split across tasks by ``ds`` before the shuffle;
after it a well has at most one row per calendar day.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Parameters of the lineitem-derived panels; ``qty`` is the default target.
PARAMS = ["qty", "price", "disc", "tax"]
TARGET = "qty"
GRID_ROWS = 250_000  # grid rows of one task of the scale panel, at most about this many
FEW_ROWS = 25_000  # grid rows that are worth a task while cores are idle


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _daily(li: DataFrame, well: F.Column) -> DataFrame:
    return li.groupBy(well.alias("well"), F.to_date("l_shipdate").alias("ds")).agg(
        F.sum("l_quantity").alias("qty"),
        F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
    )


def grid_parts(li: DataFrame, well: F.Column) -> int:
    """Partitions for the daily grid of ``well``, in proportion to the rows the grid will have.

    Adaptive execution sizes partitions by the bytes of the observed days, which the grid multiplies,
    and never makes more than ``spark.sql.shuffle.partitions``: the rows of a task would grow with the table.
    """
    first, last = F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))
    span = li.groupBy(well.alias("well")).agg((F.datediff(last, first) + 1).alias("d"))
    rows = span.agg(F.sum("d").alias("d")).first().d or 0
    idle = min(3 * li.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / FEW_ROWS))
    return max(1, idle, math.ceil(rows / GRID_ROWS))


def daily_grid(panel: DataFrame, key: str = "well", date: str = "ds", step: str | None = None, parts: int | None = None) -> DataFrame:
    """One row per day (or per ``step``, e.g. ``"1 HOUR"``) from each well's first to last
    date; missing days get null cells.

    Each observed row expands to itself plus the missing steps up to the well's next observed
    date (``lead`` over a window by well, then ``explode(sequence(...))``): no cross join of wells
    with dates, no join back. The window's shuffle carries the aggregated panel itself, so
    adaptive execution sizes the partitions by its real volume (a shuffle of a tiny per-well
    span table would pack the whole grid into a handful of tasks) unless ``parts`` tells their number.
    The result is hash-partitioned by well.
    """
    if parts is not None:
        panel = panel.repartition(parts, key)
    vals = [c for c in panel.columns if c not in (key, date)]
    nxt = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    staged = panel.withColumn("_next", nxt)
    if step is None:
        upto = F.coalesce(F.date_sub("_next", 1), F.col(date))
        seq = F.sequence(F.col(date), F.greatest(upto, F.col(date)))
    else:
        upto = F.coalesce(F.col("_next") - F.expr(f"INTERVAL {step}"), F.col(date))
        seq = F.sequence(F.col(date), F.greatest(upto, F.col(date)), F.expr(f"INTERVAL {step}"))
    out = staged.select(key, F.col(date).alias("_obs"), *vals, F.explode(seq).alias(date))
    same = F.col(date) == F.col("_obs")
    return out.select(key, date, *[F.when(same, F.col(c)).alias(c) for c in vals])


def main_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw main panel: ``well, ds, qty, price, disc, tax`` on a daily grid (nulls = blanks)."""
    li = _lineitem(spark, sf_dir)
    return daily_grid(_daily(li, F.concat("l_returnflag", "l_linestatus")))


def scale_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scale panel keyed by supplier: ``well = cast(l_suppkey as string)``."""
    li = _lineitem(spark, sf_dir)
    well = F.col("l_suppkey")  # grouped as the number it is, named after that
    daily = _daily(li, well).withColumn("well", F.col("well").cast("string"))
    return daily_grid(daily, parts=grid_parts(li, well))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short hourly panel from ``events``: ``well = event_type``, ``ds`` = hour start."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.groupBy(
        F.col("event_type").alias("well"), F.date_trunc("hour", "ts").alias("hour")
    ).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def events_hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short panel on an hourly grid: ``well = event_type``, ``ds`` = hour, ``value`` = mean (null = no event)."""
    ev = events_panel(spark, sf_dir).select("well", F.col("hour").alias("ds"), "value")
    return daily_grid(ev, step="1 HOUR")


def to_long(panel: DataFrame, params: list[str] | None = None) -> DataFrame:
    """Wide panel -> long ``(well, ds, param, value double)``."""
    params = params or [c for c in panel.columns if c not in ("well", "ds")]
    return panel.select("well", "ds", *[F.col(p).cast("double").alias(p) for p in params]).unpivot(
        ["well", "ds"], params, "param", "value"
    )
