"""Uncertainty bands (U1-U4), and bands calibrated on earlier folds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.operators.clean import KEY
from boreflow.session import cut_lineage

Z95 = 1.96


def residual_sd(resid: DataFrame, by: Iterable[str] = (KEY,), err: str = "err") -> DataFrame:
    """Population standard deviation of the errors per group."""
    return resid.groupBy(*by).agg(F.stddev_pop(err).alias("sd"))


def normal_band(fc: DataFrame, resid: DataFrame, by: Iterable[str] = (KEY,), err: str = "err", z: float = Z95) -> DataFrame:
    """``yhat +- z * sd`` with ``sd`` the population std of the errors of the same group."""
    by = list(by)
    sd = residual_sd(resid, by, err)
    out = fc.drop("yhat_lower", "yhat_upper").join(sd, by, "left")
    return out.withColumns(
        {"yhat_lower": F.col("yhat") - F.lit(z) * F.col("sd"), "yhat_upper": F.col("yhat") + F.lit(z) * F.col("sd")}
    ).drop("sd")


def quantile_band(samples: DataFrame, by: Iterable[str], value: str = "value",
                  qs: tuple[float, float, float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact quantiles (linear interpolation) of sampled values per group.

    Output ``by..., yhat_lower, yhat, yhat_upper`` = quantiles ``qs`` (low, median, high).
    ``percentile`` is an aggregate with partial buffers; a group holds one value per sample.
    """
    q = F.percentile(value, F.array(*[F.lit(float(x)) for x in qs]))
    out = samples.groupBy(*by).agg(q.alias("_q"))
    return out.select(*by, F.col("_q")[0].alias("yhat_lower"), F.col("_q")[1].alias("yhat"), F.col("_q")[2].alias("yhat_upper"))


def with_optional_band(fc: DataFrame, band: DataFrame | None, on: Iterable[str]) -> DataFrame:
    """U4: attach bounds when a band exists; otherwise keep the forecast with null bounds."""
    on = list(on)
    base = fc.drop("yhat_lower", "yhat_upper")
    if band is None:
        return base.withColumns({"yhat_lower": F.lit(None).cast("double"), "yhat_upper": F.lit(None).cast("double")})
    return base.join(band.select(*on, "yhat_lower", "yhat_upper"), on, "left")


STEP_CLASSES = (7, 14, 30)  # last step of each class of steps ahead; later steps form one more


def step_class(step: Column, classes: Iterable[int] = STEP_CLASSES) -> Column:
    out = F.lit(0)
    for last in classes:
        out = out + (step > last).cast("int")
    return out


def conformal_band(fc: DataFrame, level: float = 0.8, by: Iterable[str] = (KEY, "model"), classes: Iterable[int] = STEP_CLASSES,
                   actual: str = "y") -> DataFrame:
    """A band around ``yhat`` that held ``level`` of the errors of the folds before (split conformal).

    The scores of a fold's test rows are their absolute errors. A row of fold k takes the scores of folds
    0 .. k-1 in its own class of steps ahead: of m scores the ceil((m + 1) level)-th smallest is its
    half-width. Where the class has too few scores for that rank, those of all steps count; where
    these are too few as well (always in fold 0), the bounds are null. Future rows come from the last
    fold number, so they take the scores of all test folds. Scores are exchangeable if errors do not
    change from fold to fold; then ``level`` is met whatever the model. A group holds at most one
    score per day of the well and fold. The forecast is computed once, into the checkpoint folder.
    """
    by, fc = list(by), cut_lineage(fc)
    test = fc.filter(F.col("part") == "test").select(*by, "fold", step_class(F.col("step"), classes).alias("_class"), F.abs(F.col(actual) - F.col("yhat")).alias("_s"))
    last = fc.agg(F.max("fold")).first()[0] or 0
    later = test.filter("_s is not null").withColumn("fold", F.explode(F.sequence(F.col("fold") + 1, F.lit(int(last) + 1)))).filter(F.col("fold") <= int(last))

    def widths(groups: list[str], name: str) -> DataFrame:
        m, sorted_ = F.size("_all"), F.col("_all")
        rank = F.ceil((m + 1) * F.lit(level)).cast("int")
        return later.groupBy(*groups).agg(F.sort_array(F.collect_list("_s")).alias("_all")).select(
            *groups, F.when(rank <= m, F.get(sorted_, rank - 1)).alias(name))

    own = widths([*by, "fold", "_class"], "_w")
    every = widths([*by, "fold"], "_v")
    out = fc.drop("yhat_lower", "yhat_upper").withColumn("_class", step_class(F.col("step"), classes))
    out = out.join(own, [*by, "fold", "_class"], "left").join(every, [*by, "fold"], "left").withColumn("_h", F.coalesce("_w", "_v"))
    return out.withColumns({"yhat_lower": F.col("yhat") - F.col("_h"), "yhat_upper": F.col("yhat") + F.col("_h")}).drop("_class", "_w", "_v", "_h")


def coverage(fc: DataFrame, by: Iterable[str] = ("model", "fold"), actual: str = "y") -> DataFrame:
    """Share of the test rows that lie inside their band, over rows that have one: ``by, n, inside, mean_width``."""
    rows = fc.filter((F.col("part") == "test") & F.col("yhat_lower").isNotNull() & F.col(actual).isNotNull())
    inside = (F.col(actual) >= F.col("yhat_lower")) & (F.col(actual) <= F.col("yhat_upper"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("inside"), F.avg(F.col("yhat_upper") - F.col("yhat_lower")).alias("mean_width"))
