"""Cleaning: blanks and zeros to null, gap filling, drops, time index, casts.

Every window here is ``partitionBy(well).orderBy(ds)`` and the interpolation takes a well's rows as one
array; after the first of them the panel stays hash-partitioned by ``well`` so later windows and per-well
aggregates add no shuffle. A well's partition holds one row per day, so its size is bounded
by the calendar span, not by how many raw rows the well had.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.functions.gaps import fill

KEY = "well"
ORDER = "ds"


def series_window(key: str = KEY, order: str = ORDER):
    return Window.partitionBy(key).orderBy(order)


def _cols(df: DataFrame, cols: Iterable[str] | None, key: str = KEY, order: str = ORDER) -> list[str]:
    if cols is None:
        return [c for c in df.columns if c not in (key, order, "time_idx", "well_id")]
    return list(cols)


def null_blanks_zeros(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Blank or non-numeric cell -> null, 0 -> null, for every listed column (target too)."""
    cols = _cols(df, cols)
    return df.withColumns({c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0)) for c in cols})


def interpolate(df: DataFrame, cols: Iterable[str] | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Linear interpolation by row position within each well.

    Interior gaps: ``prev + (next - prev) * (pos - pos_prev) / (pos_next - pos_prev)``.
    Leading gaps take the first value, trailing gaps the last one; an all-null column stays null.
    """
    cols = _cols(df, cols, key, order)
    # One aggregate per well fills the series as a whole and gives its columns back as arrays: the
    # anchors as window frames take two sorts and a handful of window passes over every row.
    rest = [c for c in df.columns if c not in (key, order)]
    fields = [F.col(order), *[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in rest]]
    row = df.select(*fields).schema
    rows = df.groupBy(key).agg(fill(row, cols, *fields).alias("_p"))
    rows = rows.select(key, F.explode(F.arrays_zip(*[F.col("_p")[n].alias(n) for n in row.names])).alias("_r"))
    return rows.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def fill_median(df: DataFrame, cols: Iterable[str] | None = None, key: str = KEY) -> DataFrame:
    """Fill nulls with the well's exact median of non-null values (zeros are null by now).

    ``median`` over the whole-well window: no join, and no shuffle once the panel is
    partitioned by well. The median buffer holds one value per day of the well.
    """
    cols = _cols(df, cols, key)
    whole = Window.partitionBy(key)
    return df.withColumns({c: F.coalesce(F.col(c), F.median(c).over(whole)) for c in cols})


def drop_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """C4: drop rows still holding a null in any listed column."""
    return df.na.drop(how="any", subset=_cols(df, cols))


def nonzero_target(df: DataFrame, target: str) -> DataFrame:
    """Keep rows whose target is not 0 (a null target is kept, as a NaN != 0 would be)."""
    return df.filter(F.col(target).isNull() | (F.col(target) != 0))


def ffill(df: DataFrame, cols: Iterable[str] | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Forward fill along the well's date order."""
    cols = _cols(df, cols, key, order)
    w = series_window(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def missing_profile(df: DataFrame, cols: Iterable[str] | None = None, key: str = KEY) -> DataFrame:
    """Per well and parameter: total, nulls, zeros and their percentages (raw panel)."""
    cols = _cols(df, cols, key)
    long = df.select(key, *[F.col(c).try_cast("double").alias(c) for c in cols]).unpivot(
        [key], cols, "param", "value"
    )
    total = F.count(F.lit(1))
    nulls = F.count_if(F.col("value").isNull())
    zeros = F.count_if(F.col("value") == 0)
    return long.groupBy(key, "param").agg(
        total.alias("total"),
        nulls.alias("nulls"),
        zeros.alias("zeros"),
        (nulls * 100.0 / total).alias("pct_null"),
        (zeros * 100.0 / total).alias("pct_zero"),
    )


def time_index(df: DataFrame, key: str = KEY, order: str = ORDER) -> DataFrame:
    """0-based integer position per well and a string series id."""
    return df.withColumns(
        {
            "time_idx": (F.row_number().over(series_window(key, order)) - 1).cast("int"),
            "well_id": F.col(key).cast("string"),
        }
    )


def to_float(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Narrow to float32 (the neural frames of the reference use float32)."""
    return df.withColumns({c: F.col(c).cast("float") for c in _cols(df, cols)})


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns to a model's contract, e.g. ``{"qty": "y"}``."""
    return df.withColumnsRenamed(mapping)


def clean(df: DataFrame, cols: Iterable[str] | None = None, method: str = "interpolate", target: str | None = None) -> DataFrame:
    """The reference's cleaning chain: C1 -> (C2 | C3) -> C4 -> C5 -> C6.

    A well that lacks a parameter altogether keeps its rows with that parameter null;
    ``dropped_wells`` reports the wells without any row left (no target).
    """
    cols = _cols(df, cols)
    out = null_blanks_zeros(df, cols)
    if method == "interpolate":
        out = interpolate(out, cols)
    elif method == "median":
        out = fill_median(out, cols)
    elif method != "none":
        raise ValueError(f"unknown fill method {method!r}")
    # A parameter a well does not have at all (no sheet for it) is not required of that well. After a fill
    # every other one has a value in all of the well's rows, so that only the target is looked at.
    if method == "none":
        whole = Window.partitionBy(KEY)
        absent = {f"_absent_{c}": F.count(c).over(whole) == 0 for c in cols if c != target}
        out = out.withColumns(absent)
        complete = F.lit(True)
        for c in cols:
            complete = complete & ((F.col(c).isNotNull() | F.col(f"_absent_{c}")) if c != target else F.col(c).isNotNull())
        out = out.filter(complete).drop(*absent)
    elif target in cols:
        out = drop_nulls(out, [target])
    if target is not None:
        out = nonzero_target(out, target)
    # C6 (forward fill) comes last in the reference's chain; after C4 no listed column holds a
    # null, so it is a no-op there and is not planned (one window sort saved). ``ffill`` stays
    # available on its own.
    return out


def dropped_wells(raw: DataFrame, cleaned: DataFrame, key: str = KEY) -> DataFrame:
    """Wells of the raw panel that cleaning left without a row: ``(well, n_days)``."""
    return raw.groupBy(key).agg(F.count(F.lit(1)).alias("n_days")).join(cleaned.select(key).distinct(), key, "left_anti")
