"""C2, C6, C8 and W1 for wells too long for one task: prefix scans over segments.

The operators of ``clean`` and ``windows`` sort a whole well in one partition, which suits daily
series. Here a well is cut into calendar segments of ``days`` days and every window is partitioned by
(well, segment):

1. each segment is summed up in one row: its number of rows and, per column, its first and last
   known value with their places;
2. those few rows are scanned per well: how many rows lie before a segment, and the last known value
   before it and the next one after it (the carry);
3. the carry is joined back by (well, segment), and each segment is finished on its own.

Results equal those of the plain operators row by row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY, ORDER

DAYS = 366
_OWN = ["_seg", "_in", "_before"]


def _segment(order: str, days: int) -> Column:
    since = F.datediff(F.to_date(order), F.to_date(F.lit("1970-01-01")))
    return F.floor(since / F.lit(days)).cast("int")


def placed(df: DataFrame, key: str = KEY, order: str = ORDER, days: int = DAYS, cols: Iterable[str] = ()) -> DataFrame:
    """The rows with ``_seg``, their 1-based place ``_in`` in it, the rows ``_before`` it, and the carry.

    Per column ``c``: ``_pv_c``, ``_pp_c`` the last known value before the segment and its 1-based
    position in the well, ``_nv_c``, ``_np_c`` the next one after it (null where there is none).
    """
    cols = list(cols)
    staged = df.withColumn("_seg", _segment(order, days))
    staged = staged.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_seg").orderBy(order)))

    def ends(c: str) -> list[Column]:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_in").alias("p"), F.col(c).alias("v")))
        return [F.min(known).alias(f"_f_{c}"), F.max(known).alias(f"_l_{c}")]

    sums = staged.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("_n"), *[e for c in cols for e in ends(c)])
    upto = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)).cast("int"))

    def whole(end: str, c: str) -> Column:
        x = F.col(f"_{end}_{c}")
        return F.when(x.isNotNull(), F.struct((x["p"] + F.col("_before")).alias("p"), x["v"].alias("v")))

    after = Window.partitionBy(key).orderBy(F.col("_seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_seg", "_before", *[x for c in cols for x in (
        F.last(whole("l", c), ignorenulls=True).over(upto).alias(f"_p_{c}"), F.last(whole("f", c), ignorenulls=True).over(after).alias(f"_x_{c}"))])
    carry = sums.select(key, "_seg", "_before", *[x for c in cols for x in (
        F.col(f"_p_{c}.p").alias(f"_pp_{c}"), F.col(f"_p_{c}.v").alias(f"_pv_{c}"), F.col(f"_x_{c}.p").alias(f"_np_{c}"), F.col(f"_x_{c}.v").alias(f"_nv_{c}"))])
    return staged.join(carry, [key, "_seg"])


def time_index(df: DataFrame, key: str = KEY, order: str = ORDER, days: int = DAYS) -> DataFrame:
    """C8 by segments: 0-based integer position per well and a string series id."""
    out = placed(df, key, order, days)
    return out.withColumns({"time_idx": (F.col("_before") + F.col("_in") - 1).cast("int"), "well_id": F.col(key).cast("string")}).drop(*_OWN)


def ffill(df: DataFrame, cols: Iterable[str], key: str = KEY, order: str = ORDER, days: int = DAYS) -> DataFrame:
    """C6 by segments: forward fill along the well's date order."""
    cols = list(cols)
    w = Window.partitionBy(key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed(df, key, order, days, cols).withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_pv_{c}")) for c in cols})
    return out.drop(*_OWN, *_carried(cols))


def _carried(cols: Iterable[str]) -> list[str]:
    return [f"_{x}_{c}" for c in cols for x in ("pp", "pv", "np", "nv")]


def interpolate(df: DataFrame, cols: Iterable[str], key: str = KEY, order: str = ORDER, days: int = DAYS) -> DataFrame:
    """C2 by segments: linear interpolation by row position; leading and trailing gaps take the nearest value."""
    cols = list(cols)
    out = placed(df, key, order, days, cols).withColumn("_pos", F.col("_before") + F.col("_in"))
    fwd = Window.partitionBy(key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rev = Window.partitionBy(key, "_seg").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v")))

    def carry(c: str, p: str, v: str) -> Column:
        return F.when(F.col(f"_{p}_{c}").isNotNull(), F.struct(F.col(f"_{p}_{c}").alias("p"), F.col(f"_{v}_{c}").alias("v")))

    out = out.withColumns({f"_b_{c}": F.coalesce(F.last(known(c), ignorenulls=True).over(rev), carry(c, "np", "nv")) for c in cols})
    out = out.withColumns({f"_a_{c}": F.coalesce(F.last(known(c), ignorenulls=True).over(fwd), carry(c, "pp", "pv")) for c in cols})

    def filled(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        between = a["v"] + (b["v"] - a["v"]) * (F.col("_pos") - a["p"]) / (b["p"] - a["p"])
        return F.coalesce(F.col(c), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between))

    return out.withColumns({c: filled(c) for c in cols}).drop(*_OWN, "_pos", *_carried(cols), *[f"_{x}_{c}" for c in cols for x in "ab"])


def supervised(df: DataFrame, target: str, n_input: int, n_out: int = 7, key: str = KEY, order: str = ORDER, days: int = DAYS,
               block: int = 1024) -> DataFrame:
    """W1 by blocks of positions: ``n_input`` values in, ``n_out`` out, as ``windows.supervised``.

    A window starts in one block and may end in the next ones, so a row goes to every block in which
    it can stand in a window: its own and, near the start of a block, those before it.
    """
    reach = n_input + n_out - 1
    block = max(block, reach)
    rows = placed(df, key, order, days).select(key, F.col(order).alias("_ds"), F.col(target).cast("double").alias("_v"), (F.col("_before") + F.col("_in") - 1).alias("_pos"))
    own = F.floor(F.col("_pos") / F.lit(block)).cast("int")
    first = F.greatest(F.floor((F.col("_pos") - F.lit(reach)) / F.lit(block)).cast("int"), F.lit(0))
    rows = rows.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(first, F.col("_own"))))
    w = Window.partitionBy(key, "_block").orderBy("_pos")
    xw, yw = w.rowsBetween(0, n_input - 1), w.rowsBetween(n_input, reach)
    out = rows.select(
        key, F.col("_pos").cast("int").alias("start_idx"), F.last("_ds").over(xw).alias("ds_end"), F.collect_list("_v").over(xw).alias("x"),
        F.collect_list("_v").over(yw).alias("y"), (F.col("_block") == F.col("_own")).alias("_mine"))
    return out.filter((F.size("x") == n_input) & (F.size("y") == n_out) & F.col("_mine")).drop("_mine")
