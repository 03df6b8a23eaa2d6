"""The evidence graph as two tables: nodes(id, ntype, attrs) and edges(src, dst, etype, weight, seq)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.staging import staged


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Union with the last written row of each key."""
    both = table.unionByName(new, allowMissingColumns=True)
    names = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("_r")).select(*keys, "_r.*")


def roots(edges: DataFrame, etype: str = "DERIVED_FROM", depth: int | None = 8) -> DataFrame:
    """(id, root) following at most `depth` derivations, or all (None); a node with several takes the smallest target.

    Ways are put together by doubling, a depth from its powers of two, and only those that go on are joined: a root
    that many end at is no key of any join.  Without a depth, the root of a circle is its smallest node.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    up = staged(edges.where(F.col("etype") == etype).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to")).where("id is not null and to is not null"), "up")
    goes_on = up.select(F.col("id").alias("to"), F.lit(True).alias("more"))
    way = staged(up.join(goes_on, "to", "left").select("id", "to", F.coalesce("more", F.lit(False)).alias("more")), "ways")
    if depth is None:
        out = _all_the_way(up, way)
    else:
        parts = []
        for bit in range(depth.bit_length()):
            way = way if bit == 0 else staged(_joined(way, way), "ways")
            if depth >> bit & 1:
                parts.append(way)
        out = reduce(_joined, parts) if parts else way.limit(0)
    return nodes.join(out.select("id", "to"), "id", "left").select("id", F.coalesce("to", "id").alias("root"))


def _joined(ways: DataFrame, then: DataFrame) -> DataFrame:
    """Ways(id, to, more) that go on by those of their ends; the others as they are."""
    further = ways.where("more").select("id", F.col("to").alias("_end")).join(then.select(F.col("id").alias("_end"), "to", "more"), "_end").select("id", "to", "more")
    return ways.where("not more").unionByName(further)


def _all_the_way(up: DataFrame, way: DataFrame) -> DataFrame:
    """Ways to their ends.  A round closes none only when all that are left lead into circles: of ways that end, the shortest would close."""
    left = way.where("more").count()
    while left:
        way = staged(_joined(way, way), "ways")
        before, left = left, way.where("more").count()
        if left == before:
            break
    if not left:
        return way
    # as many steps as there are nodes left lead onto a circle, and once more all around it
    ring = staged(up.join(way.where("more").select("id"), "id", "left_semi").select("id", "to", F.col("id").alias("low")), "circles")
    for _ in range(left.bit_length()):
        then = ring.select(F.col("id").alias("_end"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        ring = staged(ring.withColumnRenamed("to", "_end").join(then, "_end").select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low")), "circles")
    lowest = ring.select("id", F.col("to").alias("_end")).join(ring.select(F.col("id").alias("_end"), F.col("low").alias("to")), "_end").select("id", "to", F.lit(False).alias("more"))
    return way.where("not more").unionByName(lowest)


def paths(edges: DataFrame, etype: str = "DERIVED_FROM", depth: int = 8) -> DataFrame:
    """(id, path) of every node that is derived from another: itself, what it comes from, and so on to its root, at most `depth` steps; a circle ends where it closes."""
    up = edges.where(F.col("etype") == etype).groupBy("src").agg(F.min("dst").alias("up"))
    step = up.select(F.col("src").alias("_last"), "up")
    out = up.select(F.col("src").alias("id"), F.array("src", "up").alias("path"))
    for _ in range(depth - 1):
        goes_on = F.col("up").isNotNull() & ~F.array_contains("path", F.coalesce("up", F.lit("")))
        out = out.withColumn("_last", F.element_at("path", -1)).join(step, "_last", "left").select("id", F.when(goes_on, F.concat("path", F.array("up"))).otherwise(F.col("path")).alias("path"))
    return out


def independent_sources(edges: DataFrame, mode: str = "intended") -> DataFrame:
    """Number of independent origins behind each claim: derivation roots of its documents, or its documents' sources (mode "reference")."""
    claims = edges.where("etype = 'SUPPORTS'").select(F.col("src").alias("doc"), F.col("dst").alias("claim"))
    if mode == "reference":
        origin = edges.where("etype = 'PUBLISHED_BY'").select(F.col("src").alias("doc"), F.col("dst").alias("root"))
    else:
        origin = roots(edges, depth=None).withColumnRenamed("id", "doc")
    return claims.join(origin, "doc").groupBy("claim").agg(F.count_distinct("root").alias("n_independent"))


def provenance(edges: DataFrame) -> DataFrame:
    """Each claim with its documents and their sources."""
    docs = edges.where("etype = 'SUPPORTS'").select(F.col("dst").alias("claim"), F.col("src").alias("doc"))
    source = edges.where("etype = 'PUBLISHED_BY'").select(F.col("src").alias("doc"), F.col("dst").alias("source"))
    return docs.join(source, "doc", "left").groupBy("claim").agg(F.array_sort(F.collect_set(F.struct("doc", "source"))).alias("path"))


def first_reported(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """The earliest dated document behind each claim."""
    dated = edges.where("etype = 'SUPPORTS'").join(documents.select(F.col("id").alias("src"), "date").where("date is not null"), "src")
    return dated.groupBy(F.col("dst").alias("claim")).agg(F.min_by("src", F.struct("date", "src")).alias("doc"), F.min("date").alias("date"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("ntype").alias("kind")).count().unionByName(edges.groupBy(F.col("etype").alias("kind")).count())


def claims_about(edges: DataFrame, entity: str) -> DataFrame:
    return edges.where((F.col("etype") == "ABOUT") & (F.col("dst") == f"ent:{entity.lower()}")).select(F.col("src").alias("claim"))


def contradictions_of(edges: DataFrame) -> DataFrame:
    """Contradicting claims, both ways."""
    e = edges.where("etype = 'CONTRADICTS'").select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


def apply_events(edges: DataFrame, events: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges that change events imply: CHANGED supersedes, CORRECTED and CONFLICT contradict, all other claims on the same fact."""
    new = events.select("entity", "attribute", "kind", F.col("claim").alias("src"))
    met = new.join(claims.select("entity", "attribute", F.col("claim").alias("dst")), ["entity", "attribute"]).where("src <> dst")
    etype = F.when(F.col("kind") == "CHANGED", "SUPERSEDES").when(F.col("kind").isin("CORRECTED", "CONFLICT"), "CONTRADICTS")
    seq = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return edges.unionByName(met.withColumn("etype", etype).where("etype is not null").select("src", "dst", "etype", F.lit(1.0).alias("weight"), seq.cast("long").alias("seq")), allowMissingColumns=True)
