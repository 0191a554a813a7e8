"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Every stage is written as Parquet to the cluster's shared folder and read again, so a lost
executor costs at most the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boreflow.llm import stages
from boreflow.llm.text import documents, materialize

STAGES = [
    ("language_id", stages.language),
    ("simhash_dedup", stages.near_duplicates),
    ("decontamination", stages.decontaminate),
    ("mixing", stages.mix),
    ("token_output", stages.write_tokens),
]

ORACLE_SQL = None  # the language network and the token library have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
