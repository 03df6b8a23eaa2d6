"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame;
`run` writes each as Parquet under the shared folder and reads it again, so a lost executor repeats at most
its stage.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, secrets, simhash, toxicity, viterbi
from tidemark.llm.store import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles)."""
    return simhash.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items."""
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text: the other columns of documents, ids, n_ids, n_fallback, decoded_ok."""
    return viterbi.encoded(docs).drop("text")


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("decontamination", clean_of_benchmark), ("secrets", without_secrets), ("tokens", tokens)]

#: The stages hash, train and segment in ways that SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
