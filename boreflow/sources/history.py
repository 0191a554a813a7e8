"""The run history as Parquet tables partitioned by model and run.

Each run adds one row per well to ``runs`` (run time, well, target, model, horizon, fill method, the
parameters its forecast rows carry and the logged metrics of the last fold, as the reference
logs) and its forecast rows to ``forecasts``. A run counts once its row stands in ``commits``, which is
written last: readers leave out runs without one, so a run that broke off between the writes is
never seen in part. Writing a run again under its id replaces its own partitions and no others,
so a retry neither doubles nor mixes it; other runs' files are never touched. A reader filtering on
``model`` prunes partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.operators import evaluate as E
from boreflow.session import cut_lineage

_PREFIX = "run-"  # so that a partition value is never read as a number or a date
HISTORY_COLS = ["run_ts", "well", "target", "model", "horizon", "fill_method", "params", "rmse", "mae", "mape"]
FORECAST_COLS = ["run_ts", "well", "target", "model", "params", "fold", "part", "ds", "step", "y", "yhat", "yhat_lower", "yhat_upper"]


def _stamp(run_ts: str) -> Column:
    return F.lit(run_ts).cast("timestamp")


def history_rows(forecast: DataFrame, target: str, horizon: int, fill_method: str, run_ts: str) -> DataFrame:
    """One row per well: metrics of its last fold and the parameters used, both from the forecast rows."""
    met = E.metrics(forecast.filter(F.col("part") == "test"), by=("well", "model", "params", "fold"))
    last = E.last_fold(met, by=("well", "model"))
    return last.select(
        _stamp(run_ts).alias("run_ts"), "well", F.lit(target).alias("target"), "model", F.lit(int(horizon)).alias("horizon"),
        F.lit(fill_method).alias("fill_method"), "params", "rmse", "mae", "mape")


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    """Write the partitions of ``df``, replacing those of the same keys and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_history(forecast: DataFrame, path: str, target: str, horizon: int, fill_method: str, run_ts: str | None = None,
                   run_id: str | None = None) -> str:
    """Add a run's forecast rows and history rows, then commit it; returns the run's id.

    The forecast is computed once, into the checkpoint folder, and read by both writes. With
    ``run_id`` given, a repeated call replaces what an earlier one with that id wrote.
    """
    run_id = run_id or uuid.uuid4().hex
    fc = cut_lineage(forecast)
    spark = forecast.sparkSession
    stamped = run_ts or spark.sql("SELECT CAST(current_timestamp() AS STRING) AS t").first().t
    run = F.lit(_PREFIX + run_id).alias("run_id")
    full = fc.withColumns({"run_ts": _stamp(stamped), "target": F.lit(target)})
    _replace(full.select(*FORECAST_COLS, run), f"{path}/forecasts", ["model", "run_id"])
    rows = history_rows(fc, target, horizon, fill_method, stamped)
    _replace(rows.select(*HISTORY_COLS, run), f"{path}/runs", ["model", "run_id"])
    commit = spark.range(1).select(run, _stamp(stamped).alias("run_ts"))
    _replace(commit, f"{path}/commits", ["run_id"])
    return run_id


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, run_ts)`` of the runs that were written whole."""
    c = spark.read.parquet(f"{path}/commits")
    return c.select(F.substring("run_id", len(_PREFIX) + 1, 1 << 20).alias("run_id"), "run_ts")


def _read(spark: SparkSession, path: str, table: str, model: str | None) -> DataFrame:
    h = spark.read.parquet(f"{path}/{table}")
    h = h if model is None else h.filter(F.col("model") == model)
    return h.join(spark.read.parquet(f"{path}/commits").select("run_id"), "run_id", "left_semi")


def read_history(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The history of the committed runs ordered by run time, metrics rounded to 2 decimals."""
    h = _read(spark, path, "runs", model).select(*HISTORY_COLS)
    return h.withColumns({m: F.round(m, 2) for m in ("rmse", "mae", "mape")}).orderBy("run_ts", "well")


def read_forecasts(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The stored forecast rows of the committed runs."""
    return _read(spark, path, "forecasts", model).select(*FORECAST_COLS)
