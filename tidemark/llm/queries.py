"""Queries op1 to op13 and the pipeline, and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_tree_lm import score_documents

    return score_documents(_docs(spark, sf_dir))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import assign

    return assign(_docs(spark, sf_dir))


def op3_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import scan

    return scan(_docs(spark, sf_dir))


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir)).drop("text_key")


def op5_anisotropic_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.anisotropic import search

    return search(_docs(spark, sf_dir, "embeddings"))


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archive

    return archive(_docs(spark, sf_dir, "pages"))


def op7_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contamination

    return contamination(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark"))


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score_documents

    return score_documents(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def op9_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprint_log import dedup

    return dedup(_docs(spark, sf_dir))


def op10_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.viterbi import encode_documents

    return encode_documents(_docs(spark, sf_dir))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.delta_lloyd import compress

    return compress(_docs(spark, sf_dir, "embeddings"))


def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash_tables import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op13_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.filter_audit import audit

    return audit(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_tree_lm,
        op2_virtual_slots,
        op3_credential_links,
        op4_simhash_tiles,
        op5_anisotropic_mips,
        op6_warc_dictionary,
        op7_suffix_automaton,
        op8_ftrl_toxicity,
        op9_fingerprint_log,
        op10_viterbi_pieces,
        op11_delta_lloyd,
        op12_tensored_minhash,
        op13_filter_replay,
    )
}
