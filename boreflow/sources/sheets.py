"""Parameter sheets (one per parameter, dates down, wells across) and panel reshapes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _q(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def sheet_to_long(sheet: DataFrame, param: str, date_col: str | None = None, date_format: str | None = None) -> DataFrame:
    """One sheet -> ``(well, ds, param, value)``. Cells are parsed with ``try_cast`` (blank -> null).

    Dates are read by ``date_format`` (default: ISO); a date cell that does not fit fails the read
    and is named in the error, rather than becoming a row without a date.
    """
    dcol = date_col or sheet.columns[0]
    wells = [c for c in sheet.columns if c != dcol]
    ds = F.col(_q(dcol))
    ds = F.to_date(ds) if dict(sheet.dtypes)[dcol] in ("date", "timestamp", "timestamp_ntz") else _parsed(ds.cast("string"), date_format)
    wide = sheet.select(ds.alias("ds"), *[F.col(_q(w)).cast("string").alias(w) for w in wells])
    long = wide.unpivot(["ds"], [_q(w) for w in wells], "well", "value")
    return long.select("well", "ds", F.lit(param).alias("param"), F.trim("value").try_cast("double").alias("value"))


def _parsed(text: F.Column, date_format: str | None) -> F.Column:
    date = F.try_to_date(text, date_format) if date_format else F.try_to_date(text)
    bad = F.concat(F.lit("sheet date "), text, F.lit(f" does not fit the format {date_format or 'yyyy-MM-dd'}"))
    return F.when(text.isNull() | date.isNotNull(), date).otherwise(F.raise_error(bad).cast("date"))


def read_sheets(spark: SparkSession, sheets: Mapping[str, str | DataFrame], fmt: str = "csv",
                date_col: str | None = None, date_format: str | None = None) -> DataFrame:
    """Read every parameter sheet and stack them into the long panel.

    A sheet is a path (CSV with a header row of well names, or Parquet) or a DataFrame. Wells
    are the union over sheets; a well missing from one sheet simply has no rows for it.
    """
    out = None
    for param, src in sheets.items():
        if isinstance(src, str):
            reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
            src = reader.format(fmt).load(src)
        part = sheet_to_long(src, param, date_col, date_format)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sheets")
    return out


def catalog(panel_long: DataFrame) -> DataFrame:
    """Parameters and wells present, with day counts, readings and date span."""
    return panel_long.groupBy("param", "well").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("value").alias("n_values"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
    )


def select_series(panel: DataFrame, wells: Iterable[str] | None = None, params: Iterable[str] | None = None) -> DataFrame:
    """S3: keep the chosen wells and parameters (the user's selection); the filter reaches the scan."""
    out = panel if wells is None else panel.filter(F.col("well").isin(list(wells)))
    return out if params is None else out.select("well", "ds", *params)


def to_panel(panel_long: DataFrame, params: list[str]) -> DataFrame:
    """Align each well's parameters on date (outer union of dates). Duplicates are averaged.

    The parameter list is given, so the pivot needs no extra job to find its values.
    """
    return panel_long.groupBy("well", "ds").pivot("param", params).agg(F.avg("value"))


def to_wide(panel_long: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Every ``(param, well)`` side by side as ``<param>__<well>`` columns, one row per date.

    ``columns`` lists the (param, well) pairs to lay out (unique names, unlike the reference's
    duplicated well columns). Width is what the user asks for; rows stay one per date.
    """
    names = [f"{p}__{w}" for p, w in columns]
    keyed = panel_long.withColumn("_col", F.concat_ws("__", "param", "well"))
    return keyed.groupBy("ds").pivot("_col", names).agg(F.avg("value"))


def preview(df: DataFrame, n: int = 50, order: Iterable[str] = ("ds", "well")) -> DataFrame:
    """The first ``n`` rows by date (a raw-sheet view; the limit is the feature)."""
    return df.orderBy(*order).limit(n)


def series_long(panel: DataFrame, params: Iterable[str]) -> DataFrame:
    """One tidy series per (well, parameter) for plotting: ``(well, ds, param, value)``."""
    params = list(params)
    return panel.select("well", "ds", *[F.col(p).cast("double").alias(p) for p in params]).unpivot(
        ["well", "ds"], params, "param", "value"
    )
