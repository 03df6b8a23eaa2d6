"""Judging retrieved evidence and answers: routing, agreement, gaps, rewriting, audits and run measures.

All take tables keyed by `query_id`, so a set of questions is one plan: claims meet the evidence of their own
question in an equi-join and the best few are kept by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import evidence as E
from tidemark.functions import text as X
from tidemark.functions.temporal import overlaps
from tidemark.operators.claims import extract

CITATION = r"(?i)\[E\d+\]|\[[a-z0-9_.#-]+\]"
FACTUAL = r"\d|is |was |reported|announced"


def names_attribute(text: Column, attribute: Column) -> Column:
    """Does a text hold one of the attribute's words? True for attributes without words."""
    found = F.lit(True)
    for name, words in E.ATTRIBUTES.items():
        found = F.when(attribute == name, F.lower(text).rlike("|".join(words))).otherwise(found)
    return found


def route(claims: DataFrame, evidence: DataFrame, most: int = 5, least: float = 0.15, fallback: int = 2) -> DataFrame:
    """Evidence that can settle each claim, best first.

    claims(query_id, claim_id, text, subject, attribute, valid_from, valid_to), evidence(query_id, doc_id, text,
    source, valid_from, valid_to).  Only texts that mention the subject count; among them those of an overlapping
    period that name the attribute, or all where none does; of these the `most` with a word share above `least`, or
    the first `fallback`.  A question has at most twelve focused claims and k texts, which bounds its pairs.  Returns query_id, claim_id, doc_id, share, rank and the evidence columns as etext, source.
    """
    c = claims.select("query_id", "claim_id", "text", "subject", "attribute", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    e = evidence.select("query_id", "doc_id", F.col("text").alias("etext"), "source", "valid_from", "valid_to")
    pair = c.join(e, "query_id").where(F.coalesce(X.mentions(F.col("etext"), F.coalesce("subject", F.lit(""))), F.lit(False)))
    dated = (F.col("_from").isNotNull() | F.col("_to").isNotNull()) & (F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull())
    fits = (~dated | overlaps(F.col("_from"), F.col("_to"), F.col("valid_from"), F.col("valid_to"))) & names_attribute(F.col("etext"), F.coalesce("attribute", F.lit("")))
    pair = pair.withColumns({"fits": F.coalesce(fits, F.lit(False)), "share": F.round(E.coverage(E.content_tokens(F.col("text")), E.content_tokens(F.col("etext"))), 9)})
    by = Window.partitionBy("query_id", "claim_id")
    pool = pair.withColumn("_any", F.max(F.col("fits").cast("int")).over(by)).where(F.col("fits") | (F.col("_any") == 0))
    ranked = pool.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("share"), "doc_id")), "_top": F.max("share").over(by)})
    kept = F.when(F.col("_top") > least, (F.col("share") > least) & (F.col("rank") <= most)).otherwise(F.col("rank") <= fallback)
    return ranked.where(kept).select("query_id", "claim_id", "doc_id", "share", "rank", "etext", "source", "valid_from", "valid_to")


def focused(claims: DataFrame, questions: DataFrame, most: int = 12) -> DataFrame:
    """The first `most` claims that bear on each question(query_id, question, entity, attribute).

    Claims need the asked attribute and a subject that contains the entity; a question without a known attribute
    shares a word of four letters or more with its claims.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    q = questions.select("query_id", "question", F.coalesce("entity", F.lit("")).alias("_entity"), F.coalesce("attribute", F.lit("")).alias("_attribute"))
    rows = claims.join(q, "query_id")
    about = (F.col("_entity") == "") | ((F.col("subject") != "") & X.contains_entity(F.col("subject"), F.col("_entity")))
    asked = F.filter(words(F.col("question")), lambda w: ~F.contains(F.lower("_entity"), w))
    shared = (F.size(asked) == 0) | F.arrays_overlap(asked, words(F.col("text")))
    right = F.when(F.col("_attribute") != "", F.col("attribute") == F.col("_attribute")).otherwise(shared)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "start", "claim_id"))
    return rows.where(about & right).withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", *[c for c in claims.columns if c != "query_id"])


def agreement(values: DataFrame) -> DataFrame:
    """Share of the most frequent normalised value among values(query_id, value); 1 where there is none."""
    counted = values.withColumn("_v", F.nullif(X.norm_value(F.col("value")), F.lit(""))).groupBy("query_id", "_v").agg(F.count("_v").alias("n"))
    return counted.groupBy("query_id").agg(F.coalesce(F.max("n") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("agreement"))


def temporal_split(evidence: DataFrame, fit: Column, threshold: float = 0.5) -> DataFrame:
    """Counts of fresh and stale evidence for each question, and a note where the current state rests on stale texts alone."""
    fresh = F.coalesce(fit >= threshold, F.lit(False))
    per = evidence.groupBy("query_id").agg(F.count_if(fresh).alias("n_fresh"), F.count_if(~fresh).alias("n_stale"))
    return per.withColumn("only_stale", (F.col("n_fresh") == 0) & (F.col("n_stale") > 0))


def gaps(state: DataFrame) -> DataFrame:
    """Named gaps of state(n_independent, min_sources, intent, n_fresh, n_history, n_changes, needs_both, score), and sufficiency."""
    named = [
        (F.col("n_independent") == 0, "no evidence"),
        (F.col("n_independent") < F.col("min_sources"), "independent sources"),
        ((F.col("intent") == "CURRENT") & (F.col("n_fresh") == 0), "current evidence"),
        (F.col("needs_both") & (F.col("n_history") < 2), "prior state"),
        ((F.col("intent") == "CHANGE") & (F.col("n_changes") == 0), "date of the change"),
    ]
    found = F.array_compact(F.array(*[F.when(c, name) for c, name in named]))
    return state.withColumn("gaps", found).withColumn("sufficient", (F.size("gaps") == 0) & (F.col("score") >= 0.45))


def answer_claims(answers: DataFrame) -> DataFrame:
    """Claims of answers(query_id, answer, subject) for self-verification; [E1] marks are left out first."""
    plain = answers.select(F.col("query_id").alias("doc_id"), F.regexp_replace("answer", r"\[E\d+\]", "").alias("text"), "subject")
    return extract(plain).withColumnRenamed("doc_id", "query_id")


def rewrite(verdicts: DataFrame) -> DataFrame:
    """Sentences that may stand in an answer, from (claim_id, text, verdict, backing array, refuting array, valid_to).

    Supported claims carry up to three citations, conflicts state both sides, outdated claims their end; what is
    refuted or unsupported is dropped.
    """
    backing, refuting = F.coalesce("backing", F.array().cast("array<string>")), F.coalesce("refuting", F.array().cast("array<string>"))
    cites = F.array_join(F.transform(F.slice(backing, 1, 3), lambda d: F.concat(F.lit("["), d, F.lit("]"))), ", ")
    side = lambda a, other: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(other))
    out = (
        F.when(F.col("verdict") == "SUPPORTED", F.trim(F.concat_ws(" ", "text", cites)))
        .when(F.col("verdict") == "CONFLICTED", F.concat(F.lit("Sources differ: "), side(backing, "one source"), F.lit(" backs '"), F.col("text"), F.lit("', "), side(refuting, "another source"), F.lit(" reports otherwise.")))
        .when(F.col("verdict") == "TEMPORAL_MISMATCH", F.concat(F.col("text"), F.lit(" (known to hold until "), F.coalesce(F.col("valid_to").cast("string"), F.lit("an earlier period")), F.lit("; not confirmed since)")))
    )
    return verdicts.withColumn("sentence", out).where(F.col("sentence").isNotNull())


def conflict_summary(classified: DataFrame, shown: int = 5) -> DataFrame:
    """For each entity and attribute: pairs, serious ones (severity of one half and more), and the first few of these in words."""
    serious = F.col("severity") >= 0.5
    words = F.concat(F.col("value_a"), F.lit(" / "), F.col("value_b"))
    by = Window.partitionBy("entity", "attribute").orderBy(F.desc("severity"), "seq_a", "seq_b")
    top = classified.withColumn("_r", F.row_number().over(by))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(serious & (F.col("_r") <= shown), F.struct("_r", words.alias("w"))))), lambda s: s["w"]), "; ")
    return top.groupBy("entity", "attribute").agg(F.count_if(F.col("conflict_type") != "NONE").alias("n_pairs"), F.count_if(serious).alias("n_serious"), listed.alias("summary"))


def compared_amounts(amounts: DataFrame, days: int = 7) -> DataFrame:
    """Highest and lowest entity, gap, ratio and aligned periods of amounts(query_id, entity, n, valid_from, valid_to), a row for each query_id.

    Periods are aligned where all starts, and all ends, lie within `days` of each other; open bounds only with open ones.
    """
    near = lambda c: (F.count_if(F.col(c).isNull()) == F.count("*")) | ((F.count_if(F.col(c).isNull()) == 0) & (F.datediff(F.max(c), F.min(c)) <= days))
    return amounts.groupBy("query_id").agg(
        F.count("*").alias("n_entities"), F.max_by("entity", F.struct("n", "entity")).alias("highest"), F.min_by("entity", F.struct("n", "entity")).alias("lowest"),
        (F.max("n") - F.min("n")).alias("gap"), F.when(F.min("n") > 0, F.max("n") / F.min("n")).alias("ratio"), F.coalesce(near("valid_from") & near("valid_to"), F.lit(False)).alias("aligned"),
    )


def citation_audit(answers: DataFrame) -> DataFrame:
    """Sentences, cited sentences and cited share of factual ones of answers(query_id, answer)."""
    parts = F.filter(F.split(F.coalesce("answer", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    cited = F.filter(parts, lambda s: s.rlike(CITATION))
    factual = F.filter(parts, lambda s: s.rlike(FACTUAL))
    out = answers.select("query_id", F.size(parts).alias("n_sentences"), F.size(cited).alias("n_cited"), F.size(factual).alias("n_factual"), F.size(F.filter(factual, lambda s: ~s.rlike(CITATION))).alias("n_uncited_factual"))
    return out.withColumn("citation_density", F.col("n_cited") / F.greatest("n_factual", F.lit(1)))


def run_measures(results: DataFrame) -> DataFrame:
    """Questions, accuracy and refusals by system and category, and for all categories, of results(system, category, correct, abstained)."""
    return results.rollup("system", "category").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count_if("abstained").alias("n_abstained")).where("system is not null").withColumn("category", F.coalesce("category", F.lit("ALL")))
