"""How filters interact: every order of five filters replayed on every document.

Each document has one bit for each filter that it fails.  The documents' flags meet the 120 orders, which are
broadcast (that many rows at every size of the input, so this isn't a join that grows with its square), each
pair gives the place of its first failure, its five steps are exploded, and conditional sums are taken by part,
order and step.  All of that is one stage of generated code up to the partial sums: what is shuffled is 600 rows
for each part that a task has seen.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.skew import joined
from tidemark.llm.store import staged

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed): bit 0 for A to bit 4 for E, staged; one row for each row of the input.

    A: under 50 words. B: under 65 % distinct words. C: over 5 % capitals A-Z. D: holds any of ``#$%&*|``.
    E: the text of a row with a smaller doc_id.  Equal texts are those of equal SHA-256.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    tests = (words < 50, 100 * distinct < 65 * words, 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 5 * F.length("text"), F.col("text").rlike(r"[#$%&*|]"))
    flags = staged(rows.select("doc_id", "part", _mask(tests).alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")), "failures")
    copies = staged(flags.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "copies")
    known = joined(flags, copies, ["digest"], flags.count())
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return staged(known.select("doc_id", "part", F.col("failed").bitwiseOR(F.when(again, 16).otherwise(0)).alias("failed")), "failures")


def _mask(tests: tuple[Column, ...]) -> Column:
    return reduce(Column.bitwiseOR, [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)])


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts by part, filter_order and step of flags(part, failed, good, toxic), every order of the filters applied from left to right."""
    n = len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = [("".join(o), [bit[f] for f in o]) for o in permutations(filters)]
    orders = flags.sparkSession.createDataFrame(rows, "filter_order string, bits array<int>")
    orders = orders.select("filter_order", *[F.col("bits")[i].alias(f"b{i}") for i in range(n)], F.transform("bits", lambda b, i: F.struct((i + 1).alias("step"), b.alias("bit"))).alias("steps"))
    pairs = flags.crossJoin(F.broadcast(orders))
    failed = F.col("failed")
    first = reduce(lambda later, i: F.when(failed.bitwiseAND(F.col(f"b{i}")) != 0, i + 1).otherwise(later), reversed(range(n)), F.lit(n + 1))
    steps = pairs.select("part", "failed", "good", "toxic", "filter_order", first.alias("first"), F.inline("steps"))
    removed = F.col("step") == F.col("first")
    fails = failed.bitwiseAND(F.col("bit")) != 0
    counts = {
        "kept": F.col("step") < F.col("first"),
        "removed": removed,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": failed == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    summed = steps.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source), order of the filters A to E and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null source the empty part.  A row without doc_id has no label, is no copy of another
    and makes none; repeated rows count each; a document whose label rows disagree has each mark that any gives.
    Labels without documents and other columns are ignored; an empty table gives no rows.
    """
    flags = failures(docs)
    is_one = lambda c: F.max(F.coalesce(labels[c].cast("long") == 1, F.lit(False)))
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    named = flags.where("doc_id is not null").join(marks, "doc_id", "left")
    nameless = flags.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})  # all null ids would meet in one task
    both = named.unionByName(nameless)
    return replay(both.select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
