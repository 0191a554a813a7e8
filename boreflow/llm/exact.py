"""Exact dedup: sorted digest runs exchanged in binomial rounds, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.text import fold_az, materialize, narrow, shuffle_partitions

FAN_BITS = 3  # runs merged at once: 2 ** FAN_BITS


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, n_bytes, proof): digest of the A-Z-folded text (null = empty).

    Length and a second, unrelated hash travel with the digest; two texts count as equal only if
    all three agree, so a digest collision alone never merges them.
    """
    d = narrow(docs, doc_id=id_col, text=text_col).withColumn("folded", fold_az(F.coalesce("text", F.lit(""))))
    return d.select(
        "doc_id",
        F.sha2(F.col("folded").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("folded").cast("long").alias("n_bytes"),
        F.xxhash64("folded").alias("proof"),
    )


KEY = ["text_sha256", "n_bytes", "proof"]


def _merge(pieces: Column, fan: int) -> Column:
    """Multiway merge of up to ``fan`` sorted arrays without repeats into one such array.

    Equal texts stand next to one another after sorting, at most one from each array; the first of them
    takes the largest identifier and the sum of the sizes, the others go.
    """
    run = F.sort_array(F.flatten(pieces))

    def same(x: Column, y: Column) -> Column:
        return (x["text_sha256"] == y["text_sha256"]) & (x["n_bytes"] == y["n_bytes"]) & (x["proof"] == y["proof"])

    def led(arr: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            mates = F.filter(F.slice(arr, i + 1, fan), lambda y: same(x, y))
            first = (i == 0) | ~same(x, F.get(arr, i - 1))
            return F.when(first, F.struct(
                *[x[k].alias(k) for k in KEY], F.array_max(F.transform(mates, lambda y: y["keep_id"])).alias("keep_id"),
                F.aggregate(mates, F.lit(0).cast("long"), lambda s, y: s + y["group_size"]).alias("group_size")))

        return F.filter(F.transform(arr, one), lambda x: x.isNotNull())

    # through a one-element array, so that the sorted run is an array of its own inside the lambda
    return F.get(F.transform(F.array(run), led), F.lit(0))


def _range_of(done: int, now: int):
    """Of a run's array, the digests whose bits done - now .. done - 1 are c: a function of c."""

    def bits(x: Column) -> Column:
        return F.shiftright(F.conv(F.substring(x["text_sha256"], 1, 8), 16, 10).cast("long"), 32 - done).bitwiseAND((1 << now) - 1)

    def part(c: Column) -> Column:
        return F.struct(c.alias("c"), F.filter("digests", lambda x: bits(x) == c).alias("piece"))

    return part


def merge_runs(runs: DataFrame, n_runs: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """Merge digest runs to one row per text: (KEY, keep_id, group_size).

    A run is one row: the sorted array of its documents' digests, each with the largest identifier and
    the number of its copies. In each round 2 ** fan_bits partner runs exchange digest ranges: every
    run is cut at the next fan_bits bits of the digests, and the partners' pieces of one range meet in one
    task, which merges them. A text with many copies has one element per run, whatever their number.
    After the last round one run is left, cut into digest ranges; runs grow fewer as ranges grow finer, so
    an array never holds more than about the documents of one run, and no round has a single target.
    """
    bits = max(1, (n_runs - 1).bit_length())
    # the first exchange brings a run's documents together; both aggregations then stay in the task
    own = runs.repartition(n_runs, "run").groupBy("run", *KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    cur = own.groupBy("run").agg(F.sort_array(F.collect_list(F.struct(*KEY, "keep_id", "group_size"))).alias("digests")).withColumn("cell", F.lit(0).cast("long"))
    done = 0
    while done < bits:
        now = min(fan_bits, bits - done)
        done += now

        cut = cur.select("run", "cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << now) - 1).cast("long")), _range_of(done, now))).alias("p"))
        cur = (
            cut.select(F.shiftright("run", now).alias("run"), (F.shiftleft("cell", now) + F.col("p.c")).alias("cell"), "p.piece").filter(F.size("piece") > 0)
            .groupBy("run", "cell").agg(F.collect_list("piece").alias("pieces"))
            .select("run", "cell", _merge(F.col("pieces"), 1 << now).alias("digests"))
        )
    return cur.select(F.explode("digests").alias("d")).select("d.*")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after folding A-Z. The row with the largest id of a group
    stays. Defined cases: a null text is the empty text; a null id loses against any other id
    (a group with only null ids has keep_id null and keeps its rows); rows repeated with the same
    id all carry that id's verdict; an empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    n_runs = 1 << max(1, (shuffle_partitions(spark) - 1).bit_length())
    d = materialize(digests(docs, id_col, text_col))
    runs = d.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(n_runs)).cast("int"))
    merged = merge_runs(runs, n_runs)
    # The winners are unique per text; a text with very many copies is split by the skew join.
    return d.join(merged, KEY, "inner").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
