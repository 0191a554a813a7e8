"""Temperature mixing of sources to target weights, DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from boreflow.llm.text import materialize, narrow, shuffle_partitions

ENTROPY_SHARE = 0.95  # target entropy as a share of the largest one (all sources alike)
MAX_PASSES = 3.0  # no source is repeated more often than this
SEED = "mix"
SECTIONS = 32  # interior points evaluated per search round
ROUNDS = 5
DIGITS = 6  # the exponent is rounded to so many digits
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text, the token measure of the mix (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def find_exponent(shares: DataFrame, scale: float, n_sources: int, entropy_share: float, max_passes: float) -> float:
    """Exponent in [0, 1] by interval search on both targets at once.

    Entropy and largest repetition both fall as the exponent grows. The result is the largest
    exponent that reaches the target entropy, or the smallest that keeps the repetition limit if
    that is larger; 1 where even the natural shares meet the first or break the second. Each round
    evaluates the points in one aggregation over the sources and narrows both intervals; only
    2 * (SECTIONS + 1) rows of sums reach the driver.
    """
    target = entropy_share * math.log(n_sources)
    low_h, high_h, low_r, high_r = 0.0, 1.0, 0.0, 1.0
    for _ in range(ROUNDS):
        points = sorted({lo + (hi - lo) * k / SECTIONS for lo, hi in ((low_h, high_h), (low_r, high_r)) for k in range(SECTIONS + 1)})
        power = F.pow("share", F.col("a"))
        rows = (
            shares.withColumn("a", F.explode(F.array(*map(F.lit, points))))
            .groupBy("a")
            .agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(F.pow("share", F.col("a") - 1)).alias("m"))
            .collect()
        )
        at = {r.a: (math.log(r.z) - r.a * r.s / r.z >= target - 1e-12, scale * r.m / r.z <= max_passes + 1e-12) for r in rows}
        low_h = max([a for a in points if at[a][0]], default=0.0)
        high_h = min([a for a in points if not at[a][0] and a > low_h], default=1.0)
        high_r = min([a for a in points if at[a][1]], default=1.0)
        low_r = max([a for a in points if not at[a][1] and a < high_r], default=0.0)
    return round(max(low_h, high_r), DIGITS)


def mix(
    docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_passes: float = MAX_PASSES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document and pass: doc_id, source, pass, n_tokens, order_key, weight, exponent.

    Source token shares are raised to one exponent and normalised to weights; a source's budget is
    its weight times ``budget`` (default: all tokens). Each source is read in passes, each pass a new
    permutation: documents fall into blocks by hash and are ordered by hash within them. Whole
    passes come first; the last one takes documents in order as long as the budget holds them, so
    every source ends within one document of its budget and never above it. Block totals tell where
    the budget ends, so running sums are needed in that one block of about sqrt(n) documents only.
    order_key sorts the mixed stream: a hash of the pass and of the row's key, which is its id, the digest
    of its text and the number of the row among rows alike, so it also tells rows with one id or
    none apart, whatever the partitioning. Defined cases: null sources form a source of their own; null
    and empty texts have no tokens and cost nothing; a very long text counts whole; a source without
    tokens gets no rows; repeated rows are separate documents of the mix; ties of the hash fall to the
    id; an empty table gives no rows; extra columns are not read. A budget that ``max_passes`` passes over
    all sources cannot fill raises ``ValueError``; no source is read more often than that.
    """
    spark = docs.sparkSession
    d = narrow(docs, doc_id=id_col, text=text_col, source=source_col)
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    alike = d.select("doc_id", "source", src.alias("src"), n_words(F.col("text")).alias("n_tokens"), digest.alias("digest")).groupBy(
        "doc_id", "source", "src", "n_tokens", "digest").agg(F.count(F.lit(1)).alias("n"))
    sized = materialize(alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(
        "doc_id", "source", "src", "n_tokens",
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", F.col("copy").cast("string")).alias("key")))
    sources = materialize(sized.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).filter("tokens > 0"))
    row = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k")).first()
    total, k = row.t or 0, row.k
    budget = total if budget is None else budget
    if budget > max_passes * total:
        raise ValueError(f"{max_passes:g} passes over {total} tokens cannot fill a budget of {budget}")
    exponent = find_exponent(sources.withColumn("share", F.col("tokens") / total), budget / total, k, entropy_share, max_passes) if k else 1.0
    raw = F.pow(F.col("tokens") / float(max(total, 1)), F.lit(exponent))
    z = sources.agg(F.sum(raw).alias("z")).first().z or 1.0
    plan = sources.select(
        "src", "tokens", (raw / z).alias("weight"), F.least(F.round(raw / z * budget), F.floor(F.col("tokens") * max_passes)).cast("long").alias("quota"),
        F.ceil(F.sqrt("n_docs")).cast("long").alias("n_blocks"),
    )
    plan = plan.withColumn("whole", F.floor(F.col("quota") / F.col("tokens")).cast("int")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    # The plan has a row per source and salt, so no task gets all documents of a large source.
    salts = shuffle_partitions(spark)
    spread = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = sized.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(spread, ["src", "salt"])

    def key(p: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(SEED), p.cast("string"), "key").cast("binary"))

    full = rows.filter("whole > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).withColumn("order_key", key(F.col("pass")))
    last = rows.filter("rest > 0").withColumn("pass", F.col("whole")).withColumn("order_key", key(F.col("pass")))
    last = materialize(last.withColumn("block", F.pmod(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long"), F.col("n_blocks"))))
    blocks = last.groupBy("src", "rest", "block").agg(F.sum("n_tokens").alias("in_block"))
    running = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(running), F.lit(0)))
    fits = F.col("before") + F.col("in_block") <= F.col("rest")
    reached = blocks.filter(F.col("before") <= F.col("rest")).select("src", "block", "before", fits.alias("fits"))
    opened = last.join(reached, ["src", "block"])
    inner = Window.partitionBy("src", "block").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = opened.filter("not fits").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).filter("upto <= rest")
    cols = ["doc_id", "source", "pass", "n_tokens", "order_key", "weight"]
    out = full.select(cols).unionByName(opened.filter("fits").select(cols)).unionByName(cut.select(cols))
    return out.withColumn("exponent", F.lit(exponent).cast(T.DoubleType()))
