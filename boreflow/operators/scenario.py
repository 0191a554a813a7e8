"""Future frame and what-if scenario (H1-H4).

The scenario is "parameter ``p`` moves linearly by ``delta`` over the horizon": its value goes
from the last observed value to ``last + delta``, both ends included. Other regressors keep
their last value. Everything is per well: ``max_by(value, ds)`` gives the last values in one
partial aggregation, and the horizon is an ``explode(sequence(...))`` per well.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY, ORDER


def future_dates(df: DataFrame, horizon: int, include_last: bool = False, key: str = KEY, order: str = ORDER) -> DataFrame:
    """H1: ``(well, step, ds)`` for ``horizon`` daily steps after each well's last date.

    ``include_last=True`` starts on the last observed date (as most of the reference's models
    do); the default starts on the next day.
    """
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    start = 0 if include_last else 1
    last = df.groupBy(key).agg(F.max(order).alias("_d"))
    out = last.select(key, "_d", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return out.select(key, F.col("step").cast("int"), F.date_add("_d", F.col("step") - 1 + start).alias(order))


def last_values(df: DataFrame, cols: Iterable[str], key: str = KEY, order: str = ORDER) -> DataFrame:
    """The value of every column on each well's last date."""
    cols = list(cols)
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in cols])


def carry_last(future: DataFrame, df: DataFrame, cols: Iterable[str], key: str = KEY, order: str = ORDER) -> DataFrame:
    """H2: every future row gets the well's last observed regressor values.

    The last-value table has one row per well; the join is on ``well`` and Spark picks a
    broadcast only when its measured size is under the broadcast threshold.
    """
    return future.join(last_values(df, cols, key, order), key, "left")


def ramp_value(last: Column, delta: float | Column, step: Column, horizon: int) -> Column:
    """``last + delta * (step - 1) / max(horizon - 1, 1)``; a one-day horizon gives ``last``."""
    d = delta if isinstance(delta, Column) else F.lit(float(delta))
    return last + d * (step - F.lit(1)).cast("double") / F.lit(float(max(horizon - 1, 1)))


def ramp(future: DataFrame, param: str | None, delta: float, horizon: int) -> DataFrame:
    """H3: replace ``param`` (carried last value) by the linear ramp; ``None`` = no scenario."""
    if param is None:
        return future
    return future.withColumn(param, ramp_value(F.col(param), delta, F.col("step"), horizon))


def ramp_series(df: DataFrame, param: str, delta: float, horizon: int, key: str = KEY, order: str = ORDER) -> DataFrame:
    """H4: the ramp as its own dated series starting the day after the last date: ``(well, step, ds, value)``."""
    fut = carry_last(future_dates(df, horizon, False, key, order), df, [param], key, order)
    return ramp(fut, param, delta, horizon).withColumnRenamed(param, "value")


def scenario_frame(df: DataFrame, regressors: Iterable[str], param: str | None, delta: float, horizon: int,
                   include_last: bool = False, key: str = KEY, order: str = ORDER) -> DataFrame:
    """H1 + H2 + H3: the future frame a forecaster predicts on."""
    regs = list(regressors)
    fut = future_dates(df, horizon, include_last, key, order)
    if regs:
        fut = carry_last(fut, df, regs, key, order)
    return ramp(fut, param if param in regs else None, delta, horizon)
