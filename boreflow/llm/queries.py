"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.llm import decontam, exact, interaction, langid, licenses, minmax, mixing, runs, simhash, substring, tokens, toxicity, urls
from boreflow.llm.text import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), decontam.benchmark(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(documents(spark, sf_dir), tokenizer_path())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.periodic_runs(runs.repeat_tails(documents(spark, sf_dir))))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.minhash_dedup(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.interaction_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


REGISTRY = {f.__name__: f for f in (
    op1_simhash_dedup, op2_mixing, op3_license_scan, op4_substring_dedup, op5_decontamination, op6_exact_dedup,
    op7_token_output, op8_url_filter, op9_toxicity, op10_language_id,
    op11_periodic_runs, op12_minhash_dedup, op13_filter_audit,
)}
