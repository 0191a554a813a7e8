"""Regressor screening (F1-F7): autocorrelation, Pearson and Spearman, all per well.

Lags, ranks and centring are windows over ``partitionBy(well)``; the per-well sums that
follow group on ``well`` and reuse that partitioning (no further shuffle). ``screen`` makes all three
statistics in one aggregate per well. Results are small: one row per (well, regressor) or (well, column, lag).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreflow.functions.screening import screened
from boreflow.functions.stats import t_pvalue
from boreflow.operators.clean import KEY, ORDER, series_window
from boreflow.session import apply_recommended_conf

ACF_LAGS = 20
ACF_MIN = 0.2
CORR_MIN = 0.1
P_MAX = 0.05


def acf(df: DataFrame, cols: Iterable[str], nlags: int = ACF_LAGS, key: str = KEY, order: str = ORDER) -> DataFrame:
    """biased autocorrelation ``sum_t (x_t-m)(x_{t-k}-m) / sum_t (x_t-m)^2`` for k = 0..nlags.

    Output ``(well, param, lag, acf)``. All lags share one window sort.
    """
    cols = list(cols)
    whole = Window.partitionBy(key)
    w = series_window(key, order)
    centred = df.select(key, order, *[(F.col(c) - F.avg(c).over(whole)).alias(f"{c}__c") for c in cols])
    lagged = centred.select(
        key,
        *[
            (F.col(f"{c}__c") * (F.col(f"{c}__c") if k == 0 else F.lag(f"{c}__c", k).over(w))).alias(f"{c}__{k}")
            for c in cols
            for k in range(nlags + 1)
        ],
    )
    sums = lagged.groupBy(key).agg(*[F.sum(f"{c}__{k}").alias(f"{c}__{k}") for c in cols for k in range(nlags + 1)])
    return _acf_long(sums, cols, nlags, key)


def _acf_long(sums: DataFrame, cols: list[str], nlags: int, key: str) -> DataFrame:
    long = sums.select(
        key,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("param"), F.lit(k).alias("lag"),
                             F.try_divide(F.col(f"{c}__{k}"), F.col(f"{c}__0")).alias("acf"))
                    for c in cols
                    for k in range(nlags + 1)
                ]
            )
        ).alias("_a"),
    )
    return long.select(key, "_a.param", "_a.lag", "_a.acf")


def acf_screen(acf_df: DataFrame, threshold: float = ACF_MIN, key: str = KEY) -> DataFrame:
    """max ACF over lags >= 1 per (well, param) and whether it exceeds the threshold."""
    return (
        acf_df.filter(F.col("lag") >= 1)
        .groupBy(key, "param")
        .agg(F.max("acf").alias("acf_max"))
        .withColumn("keep_acf", F.col("acf_max") > threshold)
    )


def safe_corr(x: str, y: str) -> F.Column:
    """Pearson r as ``covar_pop / (stddev_pop * stddev_pop)``; a constant column gives null.

    (``corr`` divides by a zero variance and fails under ANSI mode.)
    """
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_with_target(df: DataFrame, target: str, regressors: Iterable[str], key: str = KEY) -> DataFrame:
    """Pearson r of each regressor with the target, per well: ``(well, regressor, r, n)``."""
    regs = list(regressors)
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[safe_corr(r, target).alias(r) for r in regs])
    return agg.unpivot([key, "n"], regs, "regressor", "r").select(key, "regressor", "r", "n")


def corr_screen(corr: DataFrame, threshold: float = CORR_MIN) -> DataFrame:
    """flag regressors with ``abs(r) >= threshold`` (a plain filter; every regressor is tested)."""
    return corr.withColumn("keep_corr", F.abs("r") >= threshold)


def corr_ranking(corr: DataFrame, key: str = KEY) -> DataFrame:
    """regressors ranked by r, descending, per well."""
    w = Window.partitionBy(key).orderBy(F.col("r").desc_nulls_last(), F.col("regressor"))
    return corr.withColumn("rank", F.row_number().over(w))


def _avg_rank(c: str, key: str) -> F.Column:
    """Average rank: ``rank + (ties - 1) / 2``; ties counted by a range frame on the same sort
    (``partitionBy(well).orderBy(c)``), so no extra shuffle on ``(well, c)``."""
    w = Window.partitionBy(key).orderBy(c)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w) + (ties - 1) / 2.0


def spearman(df: DataFrame, target: str, regressors: Iterable[str], key: str = KEY) -> DataFrame:
    """Spearman rho (Pearson r of average ranks), t with n-2 d.f. and two-sided p.

    Output ``(well, regressor, n, rho, t, p)``. The p-value is the only Python step, on one
    row per (well, regressor).
    """
    regs = list(regressors)
    ranked = df.select(key, *[_avg_rank(c, key).alias(c) for c in [target, *regs]])
    return _tested(corr_with_target(ranked, target, regs, key).withColumnRenamed("r", "rho"))


def _tested(rho: DataFrame) -> DataFrame:
    """t and p of ``rho`` over ``n`` rows."""
    dof = F.col("n") - 2
    t = F.col("rho") * F.sqrt(F.try_divide(dof.cast("double"), F.lit(1.0) - F.col("rho") * F.col("rho")))
    out = rho.withColumn("t", F.when(F.abs("rho") >= 1.0, F.lit(float("inf")) * F.signum("rho")).otherwise(t))
    return out.withColumn("p", t_pvalue(F.col("t"), dof.cast("double")))


def screen(df: DataFrame, target: str, regressors: Iterable[str], key: str = KEY,
           acf_min: float = ACF_MIN, corr_min: float = CORR_MIN, p_max: float = P_MAX) -> DataFrame:
    """F1-F7 together: one row per (well, regressor) with every statistic and the three flags.

    ``relevant`` = ACF and Pearson pass (the regressors the reference hands to DLT),
    ``significant`` = relevant and Spearman p < p_max (handed to LGT and KTR).
    """
    apply_recommended_conf(df.sparkSession)  # a stage that fills, rounds and filters may be too long for the JIT compiler
    regs = list(regressors)
    # One aggregate per well gives all three statistics: the panel is neither stored nor dealt out again,
    # and no row is sorted or widened by its lags for each of them.
    fields = [F.col(ORDER), *[F.col(c).cast("double") for c in [target, *regs]]]
    per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(screened(ACF_LAGS, *fields).alias("_p"))  # a row without a well is of no well
    stats = per.select(key, F.col("_p.n").alias("n"), F.explode(F.arrays_zip(
        F.array(*[F.lit(c) for c in regs]).alias("regressor"), *[F.col(f"_p.{c}").alias(c) for c in ("acf_max", "r", "rho")])).alias("_s")).select(key, "n", "_s.*")
    out = corr_screen(_tested(stats.withColumn("keep_acf", F.col("acf_max") > acf_min)), corr_min).select(
        key, "regressor", "acf_max", "keep_acf", "r", "n", "keep_corr", "rho", "p")
    relevant = F.col("keep_acf") & F.col("keep_corr")
    return out.withColumns({"relevant": relevant, "significant": relevant & (F.col("p") < p_max)})


def significant(screened: DataFrame, key: str = KEY) -> DataFrame:
    """the (well, regressor) pairs that pass all three tests."""
    return screened.filter("significant").select(key, "regressor")
