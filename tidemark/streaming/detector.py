"""Change detection and fact maintenance on streams, and their batch twins.

The detector keeps, for each source, the validators, digest, SimHash and claims of the last poll (state of one row); facts
keep their versions by (entity, attribute).  Events of a micro-batch are handled in order of (time, sequence).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_digest, hamming, norm_value, simhash
from tidemark.operators.bitemporal import timeline

STATE = "digest string, simhash long, etag string, last_modified string, polls long, changes long, claims map<string,string>"
OUTPUT = "source_id string, at timestamp, seq long, changed boolean, reason string, polls long, changes long, added array<string>, modified array<string>, removed array<string>"
NEAR_BITS = 3


def detect_batch(polls: DataFrame, near_bits: int | None = None, digest: str = "blake2b") -> DataFrame:
    """Batch twin of the content stages: each poll (source_id, at, seq, text) against the one before it.

    With `near_bits`, texts whose fingerprints differ in at most that many bits are cosmetic edits.
    """
    by = Window.partitionBy("source_id").orderBy("at", "seq")
    rows = polls.withColumn("digest", content_digest(F.col("text"))).withColumn("_before", F.lag("digest").over(by))
    near = F.lit(False)
    if near_bits is not None:
        rows = rows.withColumn("simhash", simhash(F.col("text"), digest)).withColumn("_print", F.lag("simhash").over(by))
        near = (F.col("_print") != 0) & (hamming(F.col("simhash"), F.col("_print")) <= near_bits)
    reason = F.when(F.col("_before").isNull(), "first-seen").when(F.col("_before") == F.col("digest"), "identical-content").when(near, "cosmetic-edit").otherwise("content-change")
    return rows.withColumns({"reason": reason, "changed": reason.isin("first-seen", "content-change")}).drop("_before", "_print")


def claim_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, modified and removed facts between two states (entity, attribute, value)."""
    a, b = old.select("entity", "attribute", F.col("value").alias("old_value")), new.select("entity", "attribute", F.col("value").alias("new_value"))
    both = a.join(b, ["entity", "attribute"], "full")
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(norm_value(F.col("old_value")) != norm_value(F.col("new_value")), "modified")
    return both.withColumn("kind", kind).where("kind is not null")


def _detect(key: tuple, frames: Iterator[pd.DataFrame], state, carry: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    digest, print_, etag, modified_at, polls, changes, claims = state.get if state.exists else (None, 0, None, None, 0, 0, {})
    claims, rows = dict(claims or {}), []
    norm = lambda v: " ".join(str(v).strip().lower().replace(",", "").split())
    for row in pd.concat(frames).sort_values(["at", "seq"]).itertuples(index=False):
        polls += 1
        first, added, modified, removed = polls == 1, [], [], []
        if not first and row.etag and row.etag == etag:
            reason = "etag-match"
        elif not first and row.last_modified and row.last_modified == modified_at:
            reason = "last-modified-match"
        elif not first and row.digest == digest:
            reason = "identical-content"
        else:
            if row.claims is not None:
                new = dict(row.claims)
                added = sorted(k for k in new if k not in claims)
                modified = sorted(k for k in new if k in claims and norm(new[k]) != norm(claims[k]))
                removed = sorted(k for k in claims if k not in new)
                claims = new
            seen = 0 if pd.isna(row.simhash) else int(row.simhash)
            near = not first and print_ and ((seen ^ print_) & (1 << 64) - 1).bit_count() <= NEAR_BITS
            reason = "first-seen" if first else "claim-change" if added or modified or removed else "cosmetic-edit" if near else "content-change"
            digest, print_, etag, modified_at = row.digest, seen, row.etag or etag, row.last_modified or modified_at
            changes += reason != "cosmetic-edit"
        changed = reason in ("first-seen", "claim-change", "content-change")
        rows.append((key[0], row.at, row.seq, changed, reason, polls, changes, added, modified, removed, *(getattr(row, c) for c in carry)))
    state.update((digest, print_, etag, modified_at, polls, changes, claims))
    yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in OUTPUT.split(", ")), *carry])


def detect(stream: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Stateful detector over a stream of polls (source_id, at, seq, text, etag, claims map[, last_modified]).

    Stages: HTTP validators, digest, fingerprint, claims. Null claims mean that none were extracted; only a poll
    that passes the first two stages replaces the state.  Columns in `carry` stay with their poll.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    modified_at = F.col("last_modified") if "last_modified" in stream.columns else F.lit(None).cast("string")
    rows = stream.select("source_id", "at", "seq", "etag", modified_at.alias("last_modified"), content_digest(F.col("text")).alias("digest"), simhash(F.col("text")).alias("simhash"), "claims", *carry)
    schema = ", ".join([OUTPUT, *(f"{c} {stream.schema[c].dataType.simpleString()}" for c in carry)])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        return _detect(key, frames, state, carry)

    return rows.groupBy("source_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def merge_facts(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """Timeline of all facts after a batch: for in-order facts the same whatever the batch bounds were."""
    columns = ["entity", "attribute", "value", "valid_from", "seq"]
    return timeline(current.select(columns).unionByName(arrived.select(columns)))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts of a stream by event type, with a watermark for late rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def volatility(polls: Column, changes: Column) -> Column:
    return changes / F.greatest(polls, F.lit(1))


def publish(stream: DataFrame, path: str, checkpoint: str, good: str = "payload is not null"):
    """Write well-formed messages to `path`/data and the others to `path`/dead, once each, and stop when all there is has been read."""

    def both(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.where(good).write.mode("overwrite").parquet(f"{path}/data/batch={n}")
        batch.where(f"not ({good})").write.mode("overwrite").parquet(f"{path}/dead/batch={n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Requests (client, at) in the sliding window that ends with each request, and whether these exceed the limit (all requests count)."""
    by = Window.partitionBy("client").orderBy(F.unix_micros(F.col("at").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("recent", F.count("*").over(by)).withColumn("refused", F.col("recent") > limit)
