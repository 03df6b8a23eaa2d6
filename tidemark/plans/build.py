"""From sources and documents to an engine, step by step."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.evidence import tier
from tidemark.operators.bitemporal import assert_facts
from tidemark.operators.corpus import chunks, replace_document
from tidemark.plans.answer import Config, Engine
from tidemark.sources import readers

CHUNK = "doc_id string, text string, source string, date timestamp, tier int, valid_from timestamp, valid_to timestamp, entity string"
FACT = "entity string, attribute string, seq long, value string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, source_id string, evidence_ids array<string>"


class Builder:
    """Collects facts, documents and tiers of sources; `build` folds the facts and gives an engine."""

    def __init__(self, spark: SparkSession, domain: str = "corporate") -> None:
        self.spark, self.domain, self.tiers = spark, domain, {}
        self.facts, self.documents = spark.createDataFrame([], FACT), spark.createDataFrame([], CHUNK)
        self.aliases: DataFrame | None = None

    def add_source(self, name: str, tier: int) -> Builder:
        """Fix the tier of a source."""
        self.tiers[name] = tier
        return self

    def add_facts(self, facts: DataFrame) -> Builder:
        self.facts = self.facts.unionByName(facts.select([c for c in facts.columns if c in self.facts.columns]), allowMissingColumns=True)
        return self

    def add_documents(self, documents: DataFrame) -> Builder:
        """Documents(doc_id, text[, source, date, valid_from, valid_to, entity]); one that is there already is replaced."""
        new = documents.select([c for c in documents.columns if c in self.documents.columns])
        self.documents = replace_document(self.documents, self.spark.createDataFrame([], CHUNK).unionByName(new, allowMissingColumns=True))
        return self

    def add_aliases(self, aliases: DataFrame) -> Builder:
        self.aliases = aliases if self.aliases is None else self.aliases.unionByName(aliases)
        return self

    def load(self, folder: str) -> Builder:
        """All sources of a folder, in order of precedence."""
        facts, documents = readers.load_all(self.spark, folder)
        return self.add_facts(facts).add_documents(documents)

    def load_benchmark(self, path: str) -> DataFrame:
        """The documents of a benchmark; returns its items."""
        items, documents = readers.benchmark(self.spark, path)
        stamp = {c: F.to_timestamp(c) for c in ("date", "valid_from", "valid_to")}
        self.add_documents(documents.withColumns(stamp))
        return items

    def build(self, ref: datetime, config: Config | None = None, mode: str = "reference") -> Engine:
        pieces = chunks(self.documents).select("doc_id", "chunk_id", F.col("text").alias("_text"))
        rows = self.documents.join(pieces, "doc_id").withColumn("tier", F.coalesce("tier", tier(F.coalesce("source", F.lit("")), self.domain, self.tiers)))
        rows = rows.select(F.col("chunk_id").alias("doc_id"), F.col("_text").alias("text"), "source", "date", "tier", "valid_from", "valid_to", "entity")
        return Engine(assert_facts(self.facts, mode), rows, ref, config, self.aliases)
