"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots (`SLOTS`, thousands; it never changes).  Which shard a
slot belongs to is stored apart from the records, in a table of versions that is only added to: version 1
deals the slots round, each later version is an edit that moves slots from full shards to others.
A record's shard is looked up through its slot, so rebalancing rewrites a table of `SLOTS` rows, and a map
that is given to a later run goes on from its last version.

The slot totals have `SLOTS` rows whatever the input's size; they are all that reaches the driver, and the
map is the only thing that is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import discard, documents_of, exists, new_path, staged

SLOTS = 8192
_MAP = "version int, vslot int, shard int"


class SlotMap:
    """The versioned slot-to-shard map under a path, one row for each slot that a version places or moves."""

    def __init__(self, spark: SparkSession, path: str | None = None, slots: int = SLOTS) -> None:
        self.spark, self.slots, self.path = spark, slots, path or new_path(spark, "slot-map")

    def version(self) -> int:
        """The last version that was published whole; 0 where there is none."""
        last = 0
        while exists(self.spark, f"{self.path}/v={last + 1:06d}/_SUCCESS"):
            last += 1
        return last

    def publish(self, version: int, placed: dict[int, int]) -> None:
        """Write one version: the slots that it places anew.  What an interrupted run left of it is replaced."""
        if version != self.version() + 1:
            raise ValueError(f"version {version} does not follow version {self.version()}")
        rows = [(version, int(k), int(v)) for k, v in sorted(placed.items())]
        self.spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={version:06d}")

    def load(self, upto: int | None = None) -> np.ndarray:
        """Shard of each slot as of a version (the last one), -1 for slots that none has placed."""
        shard, upto = np.full(self.slots, -1), self.version() if upto is None else upto
        if upto:
            rows = self.spark.read.schema(_MAP).parquet(*[f"{self.path}/v={v:06d}" for v in range(1, upto + 1)])
            for row in rows.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard")).toLocalIterator():
                shard[row.vslot] = row.shard
        return shard


def rebalance(shard: np.ndarray, load: np.ndarray, shards: int) -> dict[int, int]:
    """The moves that bring the shards' loads near each other: {slot: new shard}.

    Shards above the mean give away the largest slots that fit in what they have too much, these go to the
    lightest shard, largest first, and then single moves and swaps between the heaviest and the lightest shard
    narrow what is left.
    """
    new = np.where((shard >= 0) & (shard < shards), shard, -1)
    total = np.bincount(new[new >= 0], weights=load[new >= 0], minlength=shards)
    mean, pool = load.sum() / shards, list(np.flatnonzero(new < 0))
    for s in range(shards):
        for k in sorted(np.flatnonzero((new == s) & (load > 0)), key=lambda k: (-load[k], k)):
            if load[k] <= total[s] - mean:
                total[s] -= load[k]
                new[k] = -1
                pool.append(k)
    for k in sorted(pool, key=lambda k: (-load[k], k)):
        new[k] = s = int(np.argmin(total))
        total[s] += load[k]
    for _ in range(4 * shards):
        high, low = int(np.argmax(total)), int(np.argmin(total))
        gap = total[high] - total[low]
        mine, theirs = np.flatnonzero((new == high) & (load > 0)), np.flatnonzero((new == low) & (load > 0))
        if gap <= 1 or not len(mine):
            break
        given = np.r_[0.0, np.sort(load[theirs])]
        at = np.searchsorted(given, load[mine] - gap / 2).clip(0, len(given) - 1)
        shift = np.stack([load[mine] - given[np.maximum(at - 1, 0)], load[mine] - given[at]])
        left = np.where((shift > 0) & (shift < gap), np.abs(gap - 2 * shift), np.inf)
        way, best = np.unravel_index(int(np.argmin(left)), left.shape)
        if not left[way, best] < gap:
            break
        back = given[max(at[best] - 1, 0)] if way == 0 else given[at[best]]
        new[mine[best]] = low
        if back > 0:
            new[theirs[np.flatnonzero(load[theirs] == back)[0]]] = high
        total[high] -= shift[way, best]
        total[low] += shift[way, best]
    return {int(k): int(new[k]) for k in np.flatnonzero(new != shard)}


def _slotted(docs: DataFrame, slots: int) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every row, staged.

    A row's slot is a hash of its doc_id and text; a row that stands n times is hashed with n salts beside them, so
    that repeats don't share a slot.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents_of(docs).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = staged(rows.withColumns({"key": F.xxhash64("doc_id", "text_crc32"), "nth": F.monotonically_increasing_id()}), "rows")
    again = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("nth"), F.col("n"))).otherwise(0)
    slot = F.pmod(F.xxhash64("key", salt), F.lit(slots)).cast("int")
    out = staged(rows.join(again, "key", "left").select("doc_id", "size", "text_crc32", slot.alias("vslot")), "slots")
    discard(rows)
    return out


def assign(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """Put every row into a shard so that the shards' bytes are near equal (law `bytes`).

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32, law, shard, slot (the
    row's place in its shard, gapless from 0), grown_shard (null: the law is not `key`), vslot and map_version.
    A `slot_map` that has versions is continued: slots move only as far as the bytes, or another number of
    shards, ask for it, and nothing is published where none moves.  A row larger than a shard's share makes its
    shard the largest.  A null doc_id is hashed like any value, an empty table gives no rows.
    """
    spark, rows = docs.sparkSession, _slotted(docs, slots)
    totals = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()
    load, count = np.zeros(slots), np.zeros(slots, dtype=np.int64)
    load[totals["vslot"]], count[totals["vslot"]] = totals["bytes"], totals["rows"]

    slot_map = slot_map or SlotMap(spark, slots=slots)
    version = slot_map.version()
    if not version:
        version = 1
        slot_map.publish(1, {k: k % shards for k in range(slots)})
    moves = rebalance(slot_map.load(version), load, shards)
    if moves:
        version += 1
        slot_map.publish(version, moves)
    shard = slot_map.load(version)
    before = np.zeros(slots, dtype=np.int64)
    for s in range(shards):
        own = np.flatnonzero(shard == s)
        before[own] = np.cumsum(count[own]) - count[own]
    places = spark.createDataFrame([(k, int(shard[k]), int(before[k])) for k in range(slots)], "vslot int, shard int, before long")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("n", F.row_number().over(within)).join(F.broadcast(places), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"),
    )
