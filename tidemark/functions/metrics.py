"""Answer measures as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import norm_answer


def answer_match(predicted: Column, gold: Column) -> Column:
    """Does the answer contain one of the gold strings (array), both normalised?"""
    return F.exists(gold, lambda g: (g != "") & F.contains(norm_answer(predicted), norm_answer(g)))


def token_f1(predicted: Column, gold: Column) -> Column:
    words = lambda c: F.filter(F.split(norm_answer(c), " "), lambda w: w != "")
    p, g = words(predicted), words(gold)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    same = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def temporal_accuracy(answer: Column, expected: Column, outdated: Column) -> Column:
    """1 for the right value, one half if an outdated one is shown as if it held."""
    text = norm_answer(answer)
    right = F.contains(text, norm_answer(expected))
    stale = F.exists(outdated, lambda o: F.contains(text, norm_answer(o))) & ~text.rlike(r"until|previous|\bwas\b")
    return F.when(right & ~stale, 1.0).when(right, 0.5).otherwise(0.0)


def citation_accuracy(claims: Column) -> Column:
    """Share of supported ones among an answer's cited claims (array of structs with verdict, citations); 0 without any."""
    cited = F.filter(claims, lambda c: F.size(c["citations"]) > 0)
    good = F.filter(cited, lambda c: c["verdict"] == "SUPPORTED")
    return F.when(F.size(cited) > 0, F.size(good) / F.size(cited)).otherwise(0.0)


def unsupported_rate(claims: Column) -> Column:
    """Share of an answer's claims without support; 0 without claims."""
    bad = F.filter(claims, lambda c: c["verdict"].isin("INSUFFICIENT", "REFUTED"))
    return F.when(F.size(claims) > 0, F.size(bad) / F.size(claims)).otherwise(0.0)


def conflict_found(n_conflicts: Column, support_level: Column, has_conflict: Column) -> Column:
    """Did an answer show a conflict exactly where there is one?"""
    return ((n_conflicts > 0) | (support_level == "CONFLICTED")) == has_conflict


def abstention(df: DataFrame, refused: Column, should: Column) -> DataFrame:
    """Precision, recall and F1 of refusals; 1 where a denominator is empty."""
    n = df.agg(F.count_if(refused & should).alias("tp"), F.count_if(refused & ~should).alias("fp"), F.count_if(~refused & should).alias("fn"))
    part = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    n = n.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn")})
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
