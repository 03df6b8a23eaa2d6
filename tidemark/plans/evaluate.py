"""Questions of a benchmark through answer engines, and the measures of their answers.

All questions of a benchmark are one set for each engine, answers are a table, and all measures are column
expressions over it.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators.assess import run_measures
from tidemark.plans.answer import MODES, Config, Engine

# Words that mark an answer as no longer certain.
STALENESS = ("valid until", "last verified", "as of", "no current evidence", "not confirmed", "was ", "previously", "earlier period", "may no longer", "at the time")
ANSWERS = "system string, qid string, category string, answer string, abstained boolean, support_level string, n_conflicts int, coverage double, docs array<string>, expected array<string>, outdated array<string>, should_abstain boolean, has_conflict boolean"


def ladder(versions: DataFrame, chunks: DataFrame, ref: datetime, **config) -> dict[str, Engine]:
    """Engines of rising means: BM25 alone, vectors alone, both, with time and source signals, and with the store of versions."""
    return {m: Engine(versions, chunks, ref, Config(mode=m, **config)) for m in MODES}


def answers(systems: dict[str, Engine], items: DataFrame) -> DataFrame:
    """One row for each system and item(qid, question, category, expected_answer, expected_outdated, should_abstain, has_conflict): a set of questions for each system."""
    none = F.array().cast("array<string>")
    asked = items.select(
        "qid", "question", "category", F.coalesce("expected_answer", none).alias("expected"), F.coalesce("expected_outdated", none).alias("outdated"),
        F.coalesce("should_abstain", F.lit(False)).alias("should_abstain"), F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"),
    )
    parts = []
    for name, engine in systems.items():
        got = engine.answers(asked.select(F.col("qid").alias("query_id"), "question")).withColumnRenamed("query_id", "qid").drop("question")
        rows = asked.join(got, "qid").withColumns({"system": F.lit(name), "n_conflicts": F.size("conflicts"), "docs": F.transform("citations", lambda c: c["doc_id"])})
        parts.append(rows.select(*[f.split()[0] for f in ANSWERS.split(", ")]))
    return reduce(DataFrame.unionByName, parts)


def correct() -> Column:
    """Right by the rule of an item's kind: refusal, shown conflict, all states of a change, value with a mark of age, or value."""
    found = M.answer_match(F.col("answer"), F.col("expected"))
    every = F.forall("expected", lambda g: M.answer_match(F.col("answer"), F.array(g)))
    return (
        F.when(F.col("should_abstain"), F.col("abstained"))
        .when(F.col("has_conflict"), (F.col("n_conflicts") > 0) | (F.col("support_level") == "CONFLICTED"))
        .when(F.col("category") == "OUTDATED_SOURCE", found & F.lower("answer").rlike("|".join(STALENESS)))
        .when(F.col("category") == "CHANGE", every)
        .otherwise(found)
    )


def measures(rows: DataFrame) -> DataFrame:
    """Questions, accuracy and refusals by system and category (and ALL), with refusal F1, conflict detection and temporal accuracy of each system."""
    judged = rows.withColumn("correct", correct())
    conflict = M.conflict_found(F.col("n_conflicts"), F.col("support_level"), F.col("has_conflict"))
    first = F.try_element_at("expected", F.lit(1))
    refused, should = F.col("abstained"), F.col("should_abstain")
    tp, fp, fn = F.count_if(refused & should), F.count_if(refused & ~should), F.count_if(~refused & should)
    per = judged.groupBy("system").agg(
        F.when(tp + fp + fn == 0, 1.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("refusal_f1"), F.avg(conflict.cast("double")).alias("conflict_accuracy"),
        F.avg(F.when(first.isNotNull(), M.temporal_accuracy(F.col("answer"), first, F.col("outdated")))).alias("temporal_accuracy"), F.avg("coverage").alias("coverage"),
    )
    return run_measures(judged).join(per, "system")
