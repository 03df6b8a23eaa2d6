"""Substring dedup with a log-structured fingerprint index.

The index is a list of immutable runs on shared storage.  A run holds the fingerprints of the windows (20
words) that its batch of documents had and no earlier run has, sorted and packed by ranges of the fingerprint:
one row for each range, in a table bucketed by it.  Appending a batch

1. packs its fingerprints by range and merge-joins each range with the same range of every run (tables bucketed
   alike, so history is read but not shuffled): known windows, and windows that the batch has twice, are repeated;
2. looks at the batch's texts once more for the windows that may be repeated (a Bloom filter of bounded size),
   verifies them exactly and gives, for each document, the starts of windows that also start earlier;
3. writes the new fingerprints as a run, and compacts runs of like size, so there are few of them.

History's texts aren't read again.  A fingerprint is 64 bits of one hash of the 20 words and 31 bits of
another, from independent hashes of the words themselves; windows are the same where all 95 bits are.

The log's folder has a manifest of live runs, published after each append, so a later session goes on from it
and what an interrupted one left behind is ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.filters import bloom, bloom_of_ranges, maybe
from tidemark.llm.store import documents_of, exists, new_path, remove, shuffles_freed, small_batches, staged

WINDOW = 20
_NO_ID = (1 << 63) - 1
_FIRST = -(1 << 63)
_U = np.uint64
_MANIFEST = "run int, size long, buckets int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        buffer, offsets = K.text_buffer(batch.column("text"))
        for a, b in K.row_blocks(offsets):
            block, at = buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, rows = K.find_words(block, at, K.SPACE)
            yield batch.slice(a, b - a), block, starts, ends, rows


def windows_of(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows within one text; 64 bits of each, and 31 bits more (above an empty lowest bit)."""
    n = len(starts) - WINDOW + 1
    whole = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    if not len(whole):
        return whole, np.zeros(0, dtype=_U), np.zeros(0, dtype=np.uint32)
    w, check = (K.gram_hashes(K.hash_spans(block, starts, ends, family), WINDOW)[whole] for family in (0, 1))
    return whole, w, (check >> _U(33)).astype(np.uint32) << np.uint32(1)


def pack(w: np.ndarray, check: np.ndarray) -> bytes:
    """Sorted fingerprints, byte by byte so that what they share is small."""
    return zstd.compress(w.view(np.uint8).reshape(-1, 8).T.tobytes() + check.tobytes(), 1)


def unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zstd.decompress(data) if data else b""
    n = len(raw) // 12
    planes = np.frombuffer(raw, dtype=np.uint8, count=8 * n).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(_U), np.frombuffer(raw, dtype=np.uint32, offset=8 * n)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fingerprints in order; the first place of each distinct one."""
    w, check = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(w)
    w, check = w[order], check[order]
    plain, same = check >> np.uint32(1), w[1:] == w[:-1]
    if (same & (plain[1:] != plain[:-1])).any():  # equal in 64 bits only
        order = np.lexsort((plain, w))
        w, check = w[order], check[order]
        plain, same = check >> np.uint32(1), w[1:] == w[:-1]
    first = np.flatnonzero(np.r_[True, ~(same & (plain[1:] == plain[:-1]))]) if len(w) else np.zeros(0, dtype=np.int64)
    return w, check, first


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint once; its lowest bit says that it stands in more than one place."""
    w, check, first = _joined(parts)
    if not len(w):
        return w, check
    more = (np.diff(np.r_[first, len(w)]) > 1) | (np.bitwise_or.reduceat(check, first) & np.uint32(1)).astype(bool)
    return w[first], check[first] & ~np.uint32(1) | more


def fingerprints(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, data): the packed fingerprints of a batch, several rows for each range; the lowest bit says that one stands twice in its row."""
    shift, limit = _U(64 - buckets.bit_length() + 1), 1 << 20

    def give(parts: list) -> Iterator[pa.RecordBatch]:
        w, check = _distinct(parts)
        cut = np.searchsorted(w >> shift, np.arange(buckets + 1, dtype=_U))
        at = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([pack(w[cut[i] : cut[i + 1]], check[cut[i] : cut[i + 1]]) for i in at], pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, block, starts, ends, rows in _blocks(batches):
            parts.append(windows_of(block, starts, ends, rows)[1:])
            size += len(parts[-1][0])
            if size >= limit:
                yield from give(parts)
                parts, size = [], 0
        if size:
            yield from give(parts)

    return docs.select("text").mapInArrow(run, "bucket int, data binary")


class FingerprintLog:
    """Runs of fingerprints under a path that all executors share; `append` a batch, `drop` the log."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "fingerprint-log")
        self.version, self.runs = 0, []
        while exists(spark, f"{self.path}/manifest/v={self.version + 1:06d}/_SUCCESS"):
            self.version += 1
        if self.version:
            rows = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={self.version:06d}").collect()
            self.runs = sorted((r.run, r.size) for r in rows)
            buckets = rows[0].buckets
        self.buckets = buckets or 1 << max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())
        for run, _ in self.runs:
            self._table(run)

    def _name(self, run: int) -> str:
        return f"fingerprints_{hashlib.md5(self.path.encode()).hexdigest()}_{run}"

    def _where(self, run: int) -> str:
        return f"{self.path}/run-{run:06d}"

    def _table(self, run: int) -> DataFrame:
        """A run, known to this session as a table over its files."""
        tables = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        made = self.spark.read.parquet(f"{self.path}/shape-{run:06d}").first()[0] if exists(self.spark, f"{self.path}/shape-{run:06d}/_SUCCESS") else tables
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(run)} (bucket INT, data BINARY, again BINARY) USING parquet "
            f"CLUSTERED BY (bucket) SORTED BY (bucket) INTO {made} BUCKETS LOCATION '{self._where(run)}'"
        )
        return self.spark.table(self._name(run))

    def _write(self, rows: DataFrame) -> int:
        """One more run, of rows (bucket, data, again)."""
        run = 1 + max((r for r, _ in self.runs), default=0)
        while exists(self.spark, self._where(run)):
            run += 1
        made = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.spark.range(1).select(F.lit(made).alias("tables")).write.mode("overwrite").parquet(f"{self.path}/shape-{run:06d}")
        # a bucket is one row; rows come dealt by a hash of it already
        plain = {"path": self._where(run), "compression": "none", "parquet.enable.dictionary": "false"}
        with shuffles_freed(self.spark):
            rows.write.format("parquet").mode("overwrite").bucketBy(made, "bucket").sortBy("bucket").options(**plain).saveAsTable(self._name(run))
        return run

    def _merged(self, rows: DataFrame) -> DataFrame:
        """(bucket, data, again) from rows of (bucket, new: array of packed, old: array of packed)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    bucket, new, old = (batch.column(c)[i].as_py() for c in range(3))
                    mine = _distinct([unpack(x) for x in new])
                    known = np.zeros(len(mine[0]), dtype=bool)
                    for x in filter(None, old or []):
                        there = unpack(x)
                        w, check, first = _joined([(mine[0], mine[1] & ~np.uint32(1)), (there[0], there[1] | np.uint32(1))])
                        size = np.diff(np.r_[first, len(w)])
                        both = first[size == 2]
                        at = np.searchsorted(mine[0], w[both])
                        while True:  # the few that are equal in 64 bits only
                            off = np.flatnonzero(mine[1][at] >> np.uint32(1) != check[both] >> np.uint32(1))
                            if not len(off):
                                break
                            at[off] += 1
                        known[at] = True
                    repeated = known | (mine[1] & np.uint32(1)).astype(bool)
                    plain = mine[1] & ~np.uint32(1)
                    data = pack(mine[0][~known], plain[~known])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), pa.array([pack(mine[0][repeated], plain[repeated] | known[repeated])], pa.binary())], ["bucket", "data", "again"]
                    )

        return rows.mapInArrow(run, "bucket int, data binary, again binary")

    def append(self, rows: DataFrame) -> DataFrame:
        """Take in a batch (id, k, text) that stands behind all before it; (id, k, marks), staged: where its windows start that also start earlier."""
        with small_batches(rows.sparkSession):
            return self._appended(rows)

    def _appended(self, rows: DataFrame) -> DataFrame:
        new = fingerprints(rows, self.buckets).groupBy("bucket").agg(F.collect_list("data").alias("new"))
        old = [f"old_{run}" for run, _ in self.runs]
        for (run, _), name in zip(self.runs, old, strict=True):
            new = new.join(self._table(run).select("bucket", F.col("data").alias(name)), "bucket", "left")
        run = self._write(self._merged(new.select("bucket", "new", (F.array(*old) if old else F.lit(None).cast("array<binary>")).alias("old"))))
        table = self._table(run)
        marks = staged(_verified(rows, table.select("bucket", "again"), self.buckets), "marks")
        size = table.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
        self.runs.append((run, size))
        while len(self.runs) > 1 and self.runs[-1][1] >= self.runs[-2][1] * 0.75:
            self.compact(2)
        self._publish()
        return marks

    def compact(self, n: int) -> None:
        """Merge the last n runs into one."""
        some = self.runs[-n:]
        rows = self._table(some[0][0]).select("bucket", F.array("data").alias("new"))
        for run, _ in some[1:]:
            rows = rows.join(self._table(run).select("bucket", F.array("data").alias("more")), "bucket", "full").select("bucket", F.concat(F.coalesce("new", F.array().cast("array<binary>")), F.coalesce("more", F.array().cast("array<binary>"))).alias("new"))
        merged = self._write(self._merged(rows.select("bucket", "new", F.lit(None).cast("array<binary>").alias("old"))))
        self.runs = [*self.runs[:-n], (merged, sum(size for _, size in some))]
        self._publish()
        for run, _ in some:
            self._forget(run)

    def _publish(self) -> None:
        self.version += 1
        rows = [(run, int(size), self.buckets) for run, size in self.runs]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={self.version:06d}")

    def _forget(self, run: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        remove(self.spark, self._where(run))

    def drop(self) -> None:
        for run, _ in self.runs:
            self._forget(run)
        remove(self.spark, self.path)
        self.runs = []


_WINDOWS, _MARKS, _KNOWN = range(3)
_OF = {_WINDOWS: "u8 u4 i8 i8 i4".split(), _MARKS: "i8 i8 i4".split()}


def _squeezed(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """(bucket, kind, data): one row for each range of columns that are in its order, byte by byte so that what they share is small."""
    cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
    plain = [np.ascontiguousarray(c, dtype=t).view(np.uint8).reshape(len(c), -1) for c, t in zip(columns, _OF[kind], strict=True)]
    data = [zstd.compress(b"".join(c[a:b].T.tobytes() for c in plain), 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.full(len(data), kind, dtype=np.int32)), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _columns(kind: int, data: bytes) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstd.decompress(data), dtype=np.uint8), [], 0
    types = [np.dtype(t) for t in _OF[kind]]
    n = len(raw) // sum(t.itemsize for t in types)
    for t in types:
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).reshape(-1).view(t))
        at += n * t.itemsize
    return out


def _earliest(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Windows (w, check, id, k, at) in order; which are the first of their sequence, and which start after it."""
    order = np.lexsort(columns[::-1])
    for i, c in enumerate(columns):
        columns[i] = c[order]
    w, check, *of = columns
    new = np.r_[True, (w[1:] != w[:-1]) | (check[1:] != check[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    return columns, new, np.logical_or.reduce([x != x[first] for x in of])


class _Windows:
    """Windows of many documents, in memory up to a limit; equal ones are reduced to the earliest before they are shuffled."""

    LIMIT = 1 << 18

    def __init__(self, buckets: int) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.buckets, self.shift = 0, buckets, _U(64 - buckets.bit_length() + 1)

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The earliest of each sequence, packed by ranges of the fingerprint, and the later ones as packed marks."""
        if not self.size:
            return
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        columns, new, later = _earliest(columns)
        yield _squeezed(_WINDOWS, columns[0][new] >> self.shift, [c[new] for c in columns])
        marks = _Packed(self.buckets)
        marks.add(*(c[later] for c in columns[2:]))
        yield from marks.drain(whole=True)


def _marks(ids: np.ndarray, k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Window starts by document: ids, keys, lists of positions."""
    order = np.lexsort((at, k, ids))
    ids, k, at = ids[order], k[order], at[order]
    again = np.r_[False, (ids[1:] == ids[:-1]) & (k[1:] == k[:-1]) & (at[1:] == at[:-1])] if len(ids) else np.zeros(0, dtype=bool)
    ids, k, at = ids[~again], k[~again], at[~again]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (k[1:] != k[:-1])]) if len(ids) else np.zeros(0, dtype=np.int64)
    return ids[new], k[new], pa.ListArray.from_arrays(pa.array(np.r_[new, len(ids)].astype(np.int32)), pa.array(at.astype(np.int32)))


class _Packed:
    """Marks of many documents, packed by ranges of a hash of the document when there are many."""

    LIMIT = 1 << 18

    def __init__(self, buckets: int) -> None:
        self.parts, self.size, self.buckets = [], 0, buckets

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.size += len(columns[0])

    def drain(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size and (whole or self.size > self.LIMIT):
            columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            bucket = K.mix(columns[0].view(_U) * _U(0x9E3779B97F4A7C15) + columns[1].view(_U)) % _U(self.buckets)
            order = np.lexsort((*columns[::-1], bucket))
            yield _squeezed(_MARKS, bucket[order], [c[order] for c in columns])


def _brought_together(packed: DataFrame) -> DataFrame:
    """(id, k, marks) of packed marks, one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if parts:
                ids, k, lists = _marks(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(k), lists], ["id", "k", "marks"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield from done()
                    now = bucket
                parts.append(_columns(_MARKS, data.as_py()))
        yield from done()

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "id long, k long, marks array<int>")


def _verified(rows: DataFrame, again: DataFrame, buckets: int) -> DataFrame:
    """(id, k, marks): for each document of the batch, the starts of the windows that also start earlier; again: (bucket, again) of a run."""
    filter_ = rows.sparkSession.sparkContext.broadcast(bloom_of_ranges(again.select("bucket", F.col("again").alias("data")), buckets, lambda data: unpack(data)[0]))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Windows(buckets)
        for batch, block, starts, ends, at in _blocks(batches):
            whole, w, check = windows_of(block, starts, ends, at)
            may = np.flatnonzero(maybe(filter_.value, w)) if len(w) else whole
            if not len(may):
                continue
            n, whole = np.bincount(at, minlength=batch.num_rows), whole[may]
            own = (whole - (np.cumsum(n) - n)[at[whole]]).astype(np.int32)
            ids, k = (np.asarray(batch.column(c))[at[whole]] for c in ("id", "k"))
            found.add(w[may], check[may] >> np.uint32(1), ids, k, own)
            if found.size >= found.LIMIT:
                yield from found.flush()
        yield from found.flush()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, found = None, [], _Packed(buckets)

        def done() -> None:
            if parts:
                columns, _, after = _earliest([np.concatenate(x) for x in zip(*parts, strict=True)])
                parts.clear()
                found.add(*(c[after] for c in columns[2:]))

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds == _MARKS).any():  # dealt by document next
                yield batch.filter(pa.array(kinds == _MARKS))
            for i in np.flatnonzero(kinds != _MARKS).tolist():
                bucket, kind, data = (batch.column(c)[i].as_py() for c in range(3))
                if bucket != now:
                    done()
                    yield from found.drain()
                    now = bucket
                if kind == _WINDOWS:
                    parts.append(_columns(_WINDOWS, data))
                else:
                    w, check = unpack(data)
                    known = (check & np.uint32(1)).astype(bool)
                    n = int(known.sum())
                    parts.append([w[known], check[known] >> np.uint32(1), np.full(n, _FIRST), np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int32)])
        done()
        yield from found.drain(whole=True)

    types = "bucket int, kind int, data binary"
    windows = rows.select("id", "k", "text").mapInArrow(suspects, types)
    known = again.select("bucket", F.lit(_KNOWN).alias("kind"), F.col("again").alias("data"))
    dealt = windows.union(known).repartition("bucket").sortWithinPartitions("bucket")
    return _brought_together(dealt.mapInArrow(later, types).select("bucket", "data"))


def _kept(n_rows: int, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, removed words and what is left of each text, joined by single spaces."""
    n = np.bincount(rows, minlength=n_rows).astype(np.int64)
    gone = np.bincount(rows[covered], minlength=n_rows).astype(np.int64)
    keep, size = np.flatnonzero(~covered), (ends - starts)[~covered]
    # kept words side by side, each with a space behind it
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    shift = np.cumsum(size) - size
    run = np.arange(int(size.sum()))
    out[np.repeat(at - shift, size) + run] = block[np.repeat(starts[keep] - shift, size) + run]
    data, bounds = out.tobytes(), np.r_[at, len(out)]
    upto = np.searchsorted(rows[keep], np.arange(n_rows + 1))
    return n, gone, [data[bounds[a] : bounds[b] - 1] if b > a else b"" for a, b in zip(upto[:-1], upto[1:], strict=True)]


def _rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, id and k, which order documents (null ids last, then by a hash of the text) and tell different ones apart, and text."""
    k = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.when(F.col("doc_id").isNull(), 1 << 62).otherwise(0)
    return documents_of(docs).select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), k.alias("k"), "text")


def _finished(rows: DataFrame, marks: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and, of the kept words, the digest or the text."""
    keys = marks.select(F.xxhash64("id", "k").alias("h"))
    filter_ = rows.sparkSession.sparkContext.broadcast(bloom(keys))
    last, types = ("kept", "doc_id long, n_words long, n_removed long, kept string") if texts else ("kept_sha256", "doc_id long, n_words long, n_removed long, kept_sha256 string")
    names = ["doc_id", "n_words", "n_removed", last]
    shown = (lambda x: x.decode()) if texts else (lambda x: hashlib.sha256(x).hexdigest())

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without marks are finished here; the others go on, compressed."""
        coder = zstd.ZstdCompressor(level=3)
        for batch, block, starts, ends, at in _blocks(batches):
            mine = maybe(filter_.value, np.asarray(batch.column("h")).view(_U))
            packed = [coder.compress((t or "").encode()) if m else None for t, m in zip(batch.column("text").to_pylist(), mine, strict=True)]
            n, gone, kept = _kept(batch.num_rows, block, starts, ends, at, np.zeros(len(starts), dtype=bool))
            done = [pa.array(n), pa.array(gone), pa.array([None if m else shown(x) for x, m in zip(kept, mine, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "id", "k")), pa.array(packed, pa.binary()), *done], ["doc_id", "id", "k", "packed", *names[1:]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstd.ZstdDecompressor()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                lists, ready = batch.column("marks"), batch.column("packed").is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(ready)).select(names)
                open_ = np.flatnonzero(~ready)
                texts = [coder.decompress(batch.column("packed")[int(r)].as_py()) for r in open_]
                block, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
                starts, ends, at = K.find_words(block, offsets, K.SPACE)
                n = np.bincount(at, minlength=len(texts))
                change = np.zeros(len(starts) + 1, dtype=np.int64)
                lists = lists.take(pa.array(open_))
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(np.cumsum(n) - n, sizes)
                np.add.at(change, place, 1)
                np.add.at(change, place + WINDOW, -1)
                n, gone, kept = _kept(len(texts), block, starts, ends, at, np.cumsum(change)[:-1] > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(open_)), pa.array(n), pa.array(gone), pa.array([shown(x) for x in kept], pa.string())], names)

    looked = rows.withColumn("h", F.xxhash64("id", "k")).mapInArrow(first_look, "doc_id long, id long, k long, packed binary, " + types.removeprefix("doc_id long, "))
    return looked.join(marks, ["id", "k"], "left").select("doc_id", "packed", "marks", *names[1:]).mapInArrow(finish, types)


def dedup_batch(docs: DataFrame, log: FingerprintLog, texts: bool = True) -> DataFrame:
    """Append a batch to a log and take from its texts every word that a window covers which the log, or the batch, has earlier.

    Returns doc_id, n_words, n_removed and kept (the kept words joined by single spaces; else kept_sha256).  All
    of the batch stands behind what the log has; see `dedup` for its order and for nulls.
    """
    rows = _rows_of(docs)
    return _finished(rows, log.append(rows), texts)


def dedup(docs: DataFrame, batches: int = 3) -> DataFrame:
    """Remove every word that an earlier-seen 20-word window covers: doc_id, n_words, n_removed, kept_sha256 of every row.

    Documents are appended in `batches` ranges of doc_id (of about as many rows each), to a log of their own.  A null text has no words; a null
    doc_id stands last; equal rows count as one document and get one result each; of rows that share a doc_id, or
    have none, with different texts the order is that of a hash of the text; other columns are ignored; an empty
    table gives no rows.
    """
    rows = _rows_of(docs)
    bounds = rows.approxQuantile("doc_id", [b / batches for b in range(1, batches)], 0.01) if batches > 1 else []
    above = [F.coalesce(F.col("doc_id").cast("double") > b, F.lit(True)).cast("int") for b in bounds]  # null ids stand last
    span = sum(above, F.lit(0))
    log = FingerprintLog(docs.sparkSession)
    found = [log.append(rows.where(span == b)) for b in range(batches)]
    log.drop()
    marks = found[0]
    for more in found[1:]:
        marks = marks.union(more)
    with small_batches(docs.sparkSession):
        return staged(_finished(rows, marks), "deduplicated")
