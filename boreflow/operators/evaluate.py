"""Scoring and output assembly."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY, ffill


def metrics(aligned: DataFrame, by: Iterable[str] = (KEY, "model", "fold"), actual: str = "y", pred: str = "yhat") -> DataFrame:
    """N, RMSE, MAE and MAPE (percent) per group.

    MAPE skips rows whose actual is 0 (``try_divide`` gives null) instead of returning inf.
    """
    err = F.col(actual) - F.col(pred)
    return aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.abs(F.try_divide(err, F.col(actual)))) * 100.0).alias("mape"),
    )


def last_fold(fold_metrics: DataFrame, by: Iterable[str] = (KEY, "model")) -> DataFrame:
    """The metrics of the last fold per group (what the reference logs)."""
    cols = [c for c in fold_metrics.columns if c not in set(by)]
    best = F.max_by(F.struct(*cols), F.col("fold")).alias("_m")
    return fold_metrics.groupBy(*by).agg(best).select(*by, "_m.*")


def best_params(tuned: DataFrame, defaults: dict[str, str], key: str = KEY, params: str = "params") -> DataFrame:
    """Best parameters with per-key defaults: tuned values override, missing keys default."""
    dflt = F.create_map(*[x for kv in defaults.items() for x in (F.lit(kv[0]), F.lit(str(kv[1])))])
    best = F.coalesce(F.col(params), F.create_map().cast("map<string,string>"))
    keep = F.map_filter(dflt, lambda k, v: ~F.array_contains(F.map_keys(best), k))
    return tuned.withColumn(params, F.map_concat(keep, best))


def combine(test_fc: DataFrame, future_fc: DataFrame) -> DataFrame:
    """Test-period and future forecasts in one table (missing columns become null)."""
    return test_fc.unionByName(future_fc, allowMissingColumns=True)


def attach_regressors(fc: DataFrame, panel: DataFrame, regressors: list[str], key: str = KEY) -> DataFrame:
    """Join the regressors on ``(well, ds)`` and forward-fill them over the forecast rows."""
    joined = fc.join(panel.select(key, "ds", *regressors), [key, "ds"], "left")
    return ffill(joined, regressors, key, "ds")


def chart_feed(actual: DataFrame, forecast: DataFrame, target: str, ramp: DataFrame | None = None,
               regressors: Iterable[str] = (), key: str = KEY) -> DataFrame:
    """Tidy ``(well, ds, series, value)`` rows for a chart: actual, forecast, bounds, ramp, regressors."""
    parts = [actual.select(key, "ds", F.lit("actual").alias("series"), F.col(target).cast("double").alias("value"))]
    fc = forecast.select(key, "ds", "yhat", "yhat_lower", "yhat_upper").unpivot(
        [key, "ds"], ["yhat", "yhat_lower", "yhat_upper"], "series", "value"
    )
    parts.append(fc.filter(F.col("value").isNotNull()))
    if ramp is not None:
        parts.append(ramp.select(key, "ds", F.lit("ramp").alias("series"), F.col("value").cast("double")))
    for r in regressors:
        parts.append(actual.select(key, "ds", F.lit(r).alias("series"), F.col(r).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_by(df: DataFrame, metric: str = "rmse", by: Iterable[str] = (KEY,), tie: Iterable[str] = ()) -> DataFrame:
    """Best row per group by ascending metric (ties broken by ``tie`` columns)."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).asc_nulls_last(), *[F.col(t) for t in tie])
    return df.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")
