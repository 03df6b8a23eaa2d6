"""Interval joins whose work follows the rows and the pairs that they give, however many rows a key has.

The rows of a key are ranked by their start and cut into buckets of `width` ranks.  A row stands once, as the later
one of a pair, in the bucket of its own rank, and as the earlier one in every bucket that holds starts before its
end.  So each pair meets in one bucket, that of its later row; a row is copied to a further bucket only if it
overlaps rows there, and a bucket compares at most `width` later rows with what reaches into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.temporal import overlaps


def ranked(rows: DataFrame, key: tuple[str, ...], start: str, end: str, tie: str) -> DataFrame:
    """Rows with `_rank` (1, 2, ... by start within the key, open starts first, then by `tie`) and `_reach`, how many starts lie before their end."""
    marks = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("_starts"))
    # at one instant ends come before starts, since what starts there doesn't lie before the end; an open end comes last
    kind = F.when(F.col("_starts"), F.when(F.col(start).isNull(), 0).otherwise(2)).otherwise(F.when(F.col(end).isNull(), 3).otherwise(1))
    at = F.when(F.col("_starts"), F.col(start)).otherwise(F.col(end))
    side = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    by = Window.partitionBy(*key).orderBy(side, at, kind, tie).rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("_n", F.sum(F.col("_starts").cast("long")).over(by))
    same = Window.partitionBy(*key, tie)
    both = counted.withColumns({"_rank": F.max(F.when(F.col("_starts"), F.col("_n"))).over(same), "_reach": F.max(F.when(~F.col("_starts"), F.col("_n"))).over(same)})
    return both.where("_starts").drop("_starts", "_n")


def overlapping(rows: DataFrame, key: tuple[str, ...], start: str = "valid_from", end: str = "valid_to", tie: str = "seq", width: int = 64) -> DataFrame:
    """Each pair of rows of a key whose intervals [start, end) overlap, once: the key, and all other columns with `_a` (starts first, then by `tie`) and `_b`.

    Null bounds are open; `tie` tells the rows of a key apart.  Rows with a null in the key meet none.
    """
    rest = [c for c in rows.columns if c not in key]
    order = ranked(rows, key, start, end, tie)
    home = F.floor((F.col("_rank") - 1) / width)
    late = order.select(*key, home.alias("_bucket"), F.col("_rank").alias("_rank_b"), *[F.col(c).alias(f"{c}_b") for c in rest])
    last = F.greatest(home, F.floor((F.col("_reach") - 1) / width))
    early = order.select(*key, F.explode(F.sequence(home, last)).alias("_bucket"), F.col("_rank").alias("_rank_a"), *[F.col(c).alias(f"{c}_a") for c in rest])
    meet = overlaps(F.col(f"{start}_a"), F.col(f"{end}_a"), F.col(f"{start}_b"), F.col(f"{end}_b"))
    return early.join(late, [*key, "_bucket"]).where((F.col("_rank_a") < F.col("_rank_b")) & meet).drop("_bucket", "_rank_a", "_rank_b")


def segments(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans cut at every boundary of their key: the span's columns with the elementary segment [a, b), a row for each that it covers."""
    cuts = spans.select(key, F.explode(F.array(start, end)).alias("a")).distinct()
    by = Window.partitionBy(key).orderBy("a")
    cuts = cuts.withColumns({"_place": F.row_number().over(by), "b": F.lead("a").over(by)})
    place = cuts.select(key, F.col("a").alias("_at"), "_place")
    found = spans.join(place.withColumnsRenamed({"_at": start, "_place": "_from"}), [key, start]).join(place.withColumnsRenamed({"_at": end, "_place": "_to"}), [key, end])
    covered = found.where("_from < _to").withColumn("_place", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    return covered.join(cuts.where("b is not null"), [key, "_place"]).drop("_place", "_from", "_to")
