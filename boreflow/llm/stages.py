"""Pipeline stages: each applies one operator's decisions to the documents it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.llm import decontam, langid, mixing, simhash, tokens
from boreflow.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.35  # documents whose best language has a smaller mean probability are rejected


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key ``row`` that only rows alike in every column share, whatever their id.

    Keys are in the order of ids (null ids last), then of text digests. No key is null.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", digest, "lang", "source", "n_chars")
    return docs.select(*COLUMNS, key.alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or no language above LEAST_SCORE.

    The bound is low on purpose: short clean documents score less than long ones.
    """
    model = langid.train(docs)
    judged = docs.select(*COLUMNS, langid.predictor(model)("text").alias("p"))
    return judged.filter((F.col("p.lang_pred") != langid.UNDETERMINED) & (F.col("p.score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component: of the smallest id, then of the smallest text digest.

    Rows with the same id in different components are different documents; a row without an id stays
    only if its whole component has none.
    """
    keyed = _keyed(docs)
    first = simhash.simhash_dedup(keyed, id_col="row").select(F.col("component_id").alias("row")).distinct()
    return keyed.join(first, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the rows whose text contains a benchmark item, with any id or none."""
    keyed = _keyed(docs)
    found = decontam.contamination(keyed, decontam.benchmark(spark, sf_dir), id_col="row").select(F.col("doc_id").alias("row")).distinct()
    return keyed.join(found, "row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and pass of the mix; rows alike in every column are one document."""
    keyed = _keyed(docs).dropDuplicates(["row"])
    passes = mixing.mix(keyed, id_col="row").select(F.col("doc_id").alias("row"))
    return keyed.join(passes, "row").select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, and one row per written document read back from them."""
    return tokens.token_output(docs, tokenizer_path())
