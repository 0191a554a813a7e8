"""M4: time-varying coefficients by kernel smoothing over knots (the KTR slot).

Knots sit at ``c_j = train_end (j + 1/2) / K`` (j = 0..K-1) with bandwidth ``train_end / K``.
Each training row is fanned out to the K knots (a fixed, small fan-out) with the Gaussian
kernel weight ``exp(-((pos - c_j) / bw)^2 / 2)``, and a weighted ridge regression is solved per
(well, fold, knot) from weighted Gram sums. The coefficient vector at a position is the
kernel-weighted average of the knot coefficients; past the training end the position is
held at the last training row, so the forecast keeps the latest coefficients. Features:
intercept (a time-varying level), Fourier terms of period 12 (order 2) and the regressors.
Deterministic penalised least squares, not the posterior of the Bayesian model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.session import apply_recommended_conf, reuse

from boreflow.operators.backtest import backtest_rows
from boreflow.operators.clean import KEY
from boreflow.plans.models import common as M

SEASON = 12
N_KNOTS = 6


def features(regressors: Sequence[str], period: int = SEASON, order: int = 2) -> list[Column]:
    pos = F.col("pos").cast("double")
    feats = [F.lit(1.0)]
    for k in range(1, order + 1):
        ang = F.lit(2.0 * math.pi * k / period) * pos
        feats += [F.sin(ang), F.cos(ang)]
    return feats + [F.col(r).cast("double") for r in regressors]


def _centre(j: Column, n_knots: int) -> Column:
    return F.col("train_end").cast("double") * (j.cast("double") + F.lit(0.5)) / F.lit(float(n_knots))


def _weight(pos: Column, centre: Column, n_knots: int) -> Column:
    bw = F.greatest(F.col("train_end").cast("double") / F.lit(float(n_knots)), F.lit(1.0))
    d = (pos.cast("double") - centre) / bw
    return F.exp(F.lit(-0.5) * d * d)


def candidates(regressors: Sequence[str], lams: Sequence[float] = (0.1, 1.0)) -> list[M.Candidate]:
    k = len(features(regressors))
    return [M.Candidate({"lam": repr(float(lm))}, [True] * k, [0.0] + [1.0] * (k - 1), lm, "ridge") for lm in lams]


def ktr(panel: DataFrame, target: str, regressors: Sequence[str] = (), horizon: int = 30, n_knots: int = N_KNOTS,
        cands: list[M.Candidate] | None = None, n_splits: int = 5, holdout: tuple[float, float] | None = None,
        scenario: tuple[str, float] | None = None, include_last: bool = False, key: str = KEY) -> DataFrame:
    apply_recommended_conf(panel.sparkSession)
    panel = reuse(panel)
    regs = list(regressors)
    cands = cands or candidates(regs)
    feats = features(regs)
    rows = backtest_rows(panel, target, regs, n_splits, horizon, scenario, include_last, holdout, key)
    fanned = rows.filter(F.col("part") == "train").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_knots - 1))).alias("knot"))
    w = _weight(F.col("pos"), _centre(F.col("knot"), n_knots), n_knots)
    sol = M.fit(fanned, feats, [F.col("y")], cands, by=(key, "fold", "knot"), weight=w)
    coef = sol.groupBy(key, "fold", "cid").agg(
        F.max_by("params", "knot").alias("params"),
        F.array_sort(F.collect_list(F.struct("knot", "beta"))).alias("kb"),
        (F.sum("sse") / F.sum("n")).alias("mse"),
    )
    pred = rows.filter(F.col("part") != "train").join(coef, [key, "fold"])
    x = F.array(*feats)
    pc = F.least(F.col("pos"), F.col("train_end") - 1)

    def add(acc, kb):
        wt = _weight(pc, _centre(kb["knot"], n_knots), n_knots)
        val = F.aggregate(F.zip_with(kb["beta"], x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.struct((acc["num"] + wt * val).alias("num"), (acc["den"] + wt).alias("den"))

    agg = F.aggregate("kb", F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den")), add)
    yhat = agg["num"] / agg["den"]
    sd = F.sqrt(F.col("mse"))
    return pred.select(
        key, "fold", "part", "ds", "pos", "train_end", "step", "y",
        F.map_concat("params", F.create_map(F.lit("n_knots"), F.lit(str(n_knots)))).alias("params"),
        yhat.alias("yhat"), (yhat - F.lit(M.Z90) * sd).alias("yhat_lower"), (yhat + F.lit(M.Z90) * sd).alias("yhat_upper"),
        F.lit("KTR").alias("model"),
    )
