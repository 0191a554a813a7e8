"""Per-well series as sorted arrays, the input of every recursive forecaster.

One ``groupBy(well)`` collects ``(ds, value...)`` structs and sorts them by ``ds``. A well holds
one point per day, so an array is bounded by the calendar span of the panel (about 2.5k
points for seven years), never by the raw row count behind the panel.

``cut_series`` adds the training parts of a backtest and the days past the end, ``fit_rows`` turns
what a kernel made of such a row into forecast rows; no row is copied per fold and none is joined
back, since test values and dates are slices of the same arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.operators.backtest import split_bounds
from boreflow.operators.clean import KEY, ORDER


def _field(name: str):
    return lambda p: p[name]


def series_arrays(panel: DataFrame, cols: Iterable[str], key: str = KEY, order: str = ORDER) -> DataFrame:
    """``(well, n, ds0, ds1, ds array<date>, <col> array<double> ...)`` per well, sorted by date."""
    cols = list(cols)
    pts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("d"), *[F.col(c).cast("double").alias(c) for c in cols])))
    arr = panel.groupBy(key).agg(pts.alias("_p"))
    return arr.select(
        key,
        F.size("_p").cast("int").alias("n"),
        F.transform("_p", lambda p: p["d"]).alias("ds"),
        *[F.transform("_p", _field(c)).alias(c) for c in cols],
    )


def cut_series(panel: DataFrame, target: str, horizon: int = 30, n_splits: int = 5, holdout: tuple[float, float] | None = None,
               include_last: bool = False, key: str = KEY) -> tuple[DataFrame, int]:
    """``(well, _y, _ds, _days, _cuts)`` per well and the number of the final fit.

    ``_cuts`` holds (fold, train_end, begin, h): a fit on the first ``train_end`` values forecasts the
    ``h`` positions from ``begin`` on. ``_ds`` and its day numbers ``_days`` go on past the last date for the horizon.
    """
    start = 0 if include_last else 1
    ser = series_arrays(panel, [target], key)
    bounds, last = split_bounds(F.col("n"), n_splits, holdout)
    if horizon <= 0:
        bounds = F.filter(bounds, lambda b: b["fold"] < last)
    cuts = F.transform(bounds, lambda b: F.struct(
        b["fold"].alias("fold"), b["train_end"].alias("train_end"),
        F.when(b["fold"] == last, b["train_end"] + F.lit(start - 1)).otherwise(b["test_start"]).alias("begin"),
        F.when(b["fold"] == last, F.lit(max(horizon, 0))).otherwise(b["test_end"] - b["test_start"]).alias("h")))
    epoch = F.to_date(F.lit("1970-01-01"))
    more = F.transform(F.sequence(F.lit(1), F.lit(max(horizon, 1))), lambda i: F.date_add(F.col("_end"), i))
    # the last date is a column of its own: inside the lambda a column named like an alias of the select would be that alias
    staged = ser.withColumn("_end", F.element_at("ds", -1)).select(key, F.col(target).alias("_y"), cuts.alias("_cuts"), F.concat("ds", more).alias("_ds"))
    return staged.withColumn("_days", F.transform("_ds", lambda d: F.datediff(d, epoch).cast("double"))), last


def fit_rows(staged: DataFrame, fits: Column, last: int, params: Sequence[Column], model: str, key: str = KEY) -> DataFrame:
    """Forecast rows from ``fits``, an array of (fold, cid, fc, lo, hi) per row of ``cut_series``.

    ``params[cid]`` is the parameter map of a fit.
    """
    out = staged.select(key, "_y", "_ds", "_cuts", F.explode(fits).alias("_f"))
    out = out.withColumn("_c", F.get(F.filter("_cuts", lambda c: c["fold"] == F.col("_f.fold")), F.lit(0)))
    future = F.col("_f.fold") == last
    out = out.select(
        key, F.col("_f.fold").alias("fold"), F.col("_f.cid").alias("_cid"), F.col("_c.train_end").alias("train_end"), F.col("_c.begin").alias("_begin"),
        F.posexplode(F.arrays_zip(
            F.col("_f.fc").alias("yhat"), F.col("_f.lo").alias("yhat_lower"), F.col("_f.hi").alias("yhat_upper"),
            F.slice("_ds", F.col("_c.begin") + 1, F.col("_c.h")).alias("ds"),
            F.when(future, F.array().cast("array<double>")).otherwise(F.slice("_y", F.col("_c.begin") + 1, F.col("_c.h"))).alias("y"))).alias("_i", "_r"))
    pos = F.col("_begin") + F.col("_i")
    return out.select(
        key, "_r.ds", "_r.y", pos.cast("int").alias("pos"), "fold", "train_end", F.when(F.col("fold") == last, "future").otherwise("test").alias("part"),
        F.when(F.col("fold") == last, F.col("_i") + 1).otherwise(pos - F.col("train_end") + 1).cast("int").alias("step"),
        F.array(*params)[F.col("_cid")].alias("params"), "_r.yhat", "_r.yhat_lower", "_r.yhat_upper", F.lit(model).alias("model"))
