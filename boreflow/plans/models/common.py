"""Shared plumbing of the regression-type forecasters.

A candidate is a parameter map plus a feature keep mask, penalty weights, a penalty strength,
a solve method and which target it fits (0 = y, 1 = log y). All candidates of a model share
one Gram aggregation per (well, fold); the candidate fan-out happens after it, on one row per
(well, fold), so it costs no extra pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.functions import linalg as L
from boreflow.operators.clean import KEY

Z80 = 1.2816  # two-sided 80 % normal interval
Z90 = 1.6449  # two-sided 90 % (5 % / 95 % bounds)


@dataclass
class Candidate:
    params: dict[str, str]
    keep: list[bool]
    pen: list[float]
    lam: float = 0.0
    method: str = "ridge"
    target: int = 0
    extra: dict[str, float] = field(default_factory=dict)
    auto: bool = False  # auto_ridge: strength k / n from the data instead of ``lam``


def param_map(params: dict[str, str]) -> Column:
    if not params:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for kv in sorted(params.items()) for x in (F.lit(kv[0]), F.lit(str(kv[1])))])


def candidate_array(cands: Sequence[Candidate]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("cid"), F.lit(bool(c.auto)).alias("auto"), param_map(c.params).alias("params"), L.bool_array(c.keep).alias("keep"), L.dbl_array(c.pen).alias("pen"),
            F.lit(float(c.lam)).alias("lam"), F.lit(L.METHODS[c.method]).alias("method"), F.lit(c.target).alias("tgt"),
            F.create_map(*[x for kv in sorted(c.extra.items()) for x in (F.lit(kv[0]), F.lit(float(kv[1])))]
                         ).alias("extra") if c.extra else F.create_map().cast("map<string,double>").alias("extra"),
        )
        for i, c in enumerate(cands)
    ])


def fit(rows: DataFrame, feats: Sequence[Column], ys: Sequence[Column], cands: Sequence[Candidate],
        by: Sequence[str] = (KEY, "fold"), weight: Column | None = None, builder=None,
        inputs: Sequence[Column] | None = None, prefix: tuple[str, str, int] | None = None) -> DataFrame:
    """Solve every candidate on the training rows: ``by..., n, cid, params, tgt, extra, beta, sse``.

    With ``prefix=(block, fold, last)`` the rows carry a block index instead of a fold and ``by``
    names the block; the Gram of fold k sums blocks 0..k (see ``linalg.gram``).
    """
    g = L.gram(rows.filter(F.col("part") == "train"), list(by), feats, ys, weight, builder, inputs, prefix)
    if prefix is not None:
        by = [prefix[1] if b == prefix[0] else b for b in by]
    staged = g.select(*by, "n", "xtx", *[c for c in g.columns if c.startswith(("xty_", "yty_"))],
                      F.explode(candidate_array(cands)).alias("_c"))
    # The Gram table is small in bytes but each row now carries a solve: spread the solves over
    # the configured shuffle partitions (adaptive execution would size by bytes and pack them
    # into a few tasks).
    nparts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    staged = staged.repartition(nparts, *by, F.col("_c.cid"))
    xty = F.col("xty_0")
    yty = F.col("yty_0")
    for t in range(1, len(ys)):
        xty = F.when(F.col("_c.tgt") == t, F.col(f"xty_{t}")).otherwise(xty)
        yty = F.when(F.col("_c.tgt") == t, F.col(f"yty_{t}")).otherwise(yty)
    lam = F.when(F.col("_c.auto"), F.lit(float(len(feats))) / F.greatest(F.col("n"), F.lit(1.0))).otherwise(F.col("_c.lam"))
    sol = L.solve(F.col("xtx"), xty, yty, F.col("_c.keep"), F.col("_c.pen"), lam, F.col("_c.method"))
    return staged.select(*by, "n", F.col("_c.cid").alias("cid"), F.col("_c.params").alias("params"), F.col("_c.tgt").alias("tgt"),
                         F.col("_c.extra").alias("extra"), sol.alias("_s")).select(
        *by, "n", "cid", "params", "tgt", "extra", F.col("_s.beta").alias("beta"), F.col("_s.sse").alias("sse"))


def predict(rows: DataFrame, sol: DataFrame, feats: Sequence[Column], z: float = Z80, log_targets: Sequence[int] = (1,),
            by: Sequence[str] = (KEY, "fold")) -> DataFrame:
    """Test and future rows x candidates with ``yhat`` and a normal band from the in-sample residual sd.

    The linear predictor is one generated sum per (row, candidate), materialised once and
    reused by the three outputs. A log-target candidate is back-transformed with ``exp``.
    """
    pred = rows.filter(F.col("part") != "train").join(sol, list(by))
    sd = F.sqrt(F.col("sse") / F.greatest(F.col("n"), F.lit(1.0)))
    staged = pred.withColumns({"_lin": L.dot(F.col("beta"), feats), "_sd": sd}).drop("beta")
    is_log = F.col("tgt").isin(list(log_targets)) if log_targets else F.lit(False)
    lo, hi = F.col("_lin") - F.lit(z) * F.col("_sd"), F.col("_lin") + F.lit(z) * F.col("_sd")
    return staged.withColumns({
        "yhat": F.when(is_log, F.exp("_lin")).otherwise(F.col("_lin")),
        "yhat_lower": F.when(is_log, F.exp(lo)).otherwise(lo),
        "yhat_upper": F.when(is_log, F.exp(hi)).otherwise(hi),
    }).drop("sse", "n", "tgt", "extra", "cid", "_lin", "_sd")
