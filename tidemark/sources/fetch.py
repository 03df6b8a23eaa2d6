"""Monitored sources as a Python data source: a batch read fetches all of them, a stream those that are due.

A table lists the sources (`SOURCE`); each is fetched in a partition of its own, on an executor.  The stream's offset is
the start of the last polling slot of each source (its interval laid end to end from the epoch), so what is due
follows from the clock and the offset alone and survives a restart.  Intervals adapt: `rescheduled` takes them from
how often polls saw changes, and the reader looks at the table again before each batch.

A failed fetch is a row with a null text and the error, for the dead letters; it stops nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.functions.temporal import next_poll_seconds

SOURCE = "source_id string, url string, poll_seconds int, enabled boolean, entity string"
POLLED = "source_id string, at timestamp, seq long, text string, etag string, last_modified string, published timestamp, entity string, url string, error string"


class Due(InputPartition):
    """One source to fetch, for a slot."""

    def __init__(self, source: dict, slot: int) -> None:
        self.source, self.slot = source, slot


def _row(source: dict, slot: int, got: tuple[str, dict] | None, error: str | None) -> tuple:
    text, more = got or (None, {})
    published = more.get("published")
    stamp = datetime.fromisoformat(published) if isinstance(published, str) else published
    error = error or (None if got else "empty-response")
    return source["source_id"], datetime.fromtimestamp(slot, timezone.utc), slot, text, more.get("etag"), more.get("last_modified"), stamp, more.get("entity") or source.get("entity"), more.get("url") or source["url"], error


class _Reader:
    def __init__(self, source: FetchSource) -> None:
        self.options, self.fetch = source.options, source.fetch

    def now(self) -> float:
        return float(self.options.get("now", time.time()))

    def sources(self) -> list[dict]:
        files, path = pyarrow.fs.FileSystem.from_uri(self.options["path"])
        rows = ds.dataset(path, filesystem=files, format="parquet").to_table().to_pylist()
        return [r for r in rows if r["enabled"] is not False and r["source_id"] is not None]

    def read(self, partition: Due) -> Iterator[tuple]:
        try:
            yield _row(partition.source, partition.slot, self.fetch(partition.source), None)
        except Exception as problem:  # a dead source is a dead letter
            yield _row(partition.source, partition.slot, None, f"{type(problem).__name__}: {problem}"[:500])


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Due]:
        return [Due(s, int(self.now())) for s in self.sources()]


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"slots": "{}"}

    def latestOffset(self, *_: object) -> dict:
        every = lambda s: max(1, int(s["poll_seconds"] or 3600))
        return {"slots": json.dumps({s["source_id"]: int(self.now() // every(s) * every(s)) for s in self.sources()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Due]:
        before, now = json.loads(start["slots"]), json.loads(end["slots"])
        known = {s["source_id"]: s for s in self.sources()}
        return [Due(known[name], slot) for name, slot in sorted(now.items()) if slot > before.get(name, -1) and name in known]

    def commit(self, end: dict) -> None:
        pass


class FetchSource(DataSource):
    """`spark.dataSource.register(FetchSource)`, then `format("fetch")` with the table of sources as its path.

    `fetch` reads what Arrow's file systems reach; a subclass with another `fetch` (and `name`) reads elsewhere.
    """

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return POLLED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self)

    @staticmethod
    def fetch(source: dict) -> tuple[str, dict] | None:
        """The text of a source with what is known of it (etag, last_modified, published, entity, url); none without an answer."""
        files, path = pyarrow.fs.FileSystem.from_uri(source["url"])
        info = files.get_file_info(path)
        with files.open_input_stream(path) as stream:
            text = stream.read().decode("utf-8", "replace")
        return (text, {"last_modified": str(info.mtime)}) if text else None


def rescheduled(sources: DataFrame, seen: DataFrame, base: int = 3600) -> DataFrame:
    """The table of sources with intervals from seen(source_id, polls, changes), counts so far; others keep theirs."""
    most = seen.groupBy("source_id").agg(F.max("polls").alias("_polls"), F.max("changes").alias("_changes"))
    rows = sources.join(most, "source_id", "left")
    return rows.withColumn("poll_seconds", F.when(F.col("_polls").isNotNull(), next_poll_seconds(F.col("_polls"), F.col("_changes"), base)).otherwise(F.col("poll_seconds"))).select(sources.columns)
