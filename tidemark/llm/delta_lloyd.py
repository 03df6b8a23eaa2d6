"""Product codes of vectors by delta-maintained Lloyd rounds on integers.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook.  A round assigns
every part to its nearest entry and keeps, as tables in the shared folder, the assignment of every part and
the running sums (count and components) of every entry.  The next round's sums are those plus what has moved:
only parts whose assignment changed contribute, minus at the old entry and plus at the new one.  Contributions
are added up within each task, so a task shuffles at most one row for each number of the codebooks, and an
entry is the floor of sum over count.

All numbers are integers: the same in any order of rows and tasks, and after a lost executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import discard, staged

SCALE = 256
SALTS = 16
_CELLS = 1 << 19  # components looked at together


def _limit(dim: int) -> int:
    """Components are held within +-limit, so that a vector's squared error fits 62 bits."""
    return 1 << (62 - max(1, dim - 1).bit_length()) // 2 - 1


def _integers(embeddings: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, q) with q the scaled vector, zeros up to a multiple of `parts`, and that length."""
    label = embeddings["label"] if "label" in embeddings.columns else F.lit(None).cast("int")
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), label.alias("label"), embeddings["embedding"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = most["n"] if most else parts
    wide = -(-dim // parts) * parts
    bound = float(_limit(wide))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x * SCALE))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), wide - dim)) if wide > dim else whole
    return rows.where(F.size("v") == dim).select("vec_id", "label", filled.alias("q")), wide


def _first_entries(rows: DataFrame, parts: int, entries: int, dim: int) -> np.ndarray:
    """Codebooks of the vectors with the smallest ids, one for each id (of several the smallest vector), by part, entry and place."""
    ids = [r.vec_id for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if ids:
        few = rows.where(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("q").alias("q")).orderBy("vec_id").limit(entries).collect()
    else:
        few = rows.agg(F.min("q").alias("q")).where("q is not null").collect()
    start = np.array([r.q for r in few], dtype=np.int64).reshape(len(few), parts, dim // parts)
    return start.transpose(1, 0, 2)


def nearest(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (ties to the lower index) and the vector's summed squared distance; q is (row, part, place)."""
    most = 2 * int(max(np.abs(q).max(initial=0), np.abs(books).max(initial=0)))
    kind = np.float64 if most * most * q.shape[2] < 1 << 52 else np.int64  # both are exact, the first is faster
    codes, error = np.empty(q.shape[:2], dtype=np.uint8), np.zeros(len(q), dtype=np.int64)
    for p, book in enumerate(books.astype(kind)):
        x = q[:, p].astype(kind)
        away = (book * book).sum(axis=1) - 2 * (x @ book.T)
        codes[:, p] = away.argmin(axis=1)
        error += ((x * x).sum(axis=1) + away.min(axis=1)).astype(np.int64)
    return codes, error


def _blocks(batch: pa.RecordBatch, parts: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, _CELLS // dim)
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part, part.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, parts, dim // parts)


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts)


def _assigned(rows: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """The rows with `code` for the present codebooks and `before`, the code they had (null at first), staged."""
    parts = len(books)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, q in _blocks(batch, parts, dim):
                code = _binary(nearest(q, shared.value)[0])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "label", "q")), part.column("code"), code], ["vec_id", "label", "q", "before", "code"])

    had = rows if "code" in rows.columns else rows.withColumn("code", F.lit(None).cast("binary"))
    out = had.select("vec_id", "label", "q", "code").mapInArrow(run, f"vec_id long, label {label}, q array<int>, before binary, code binary")
    return staged(out, "assignment")


def _contributions(assigned: DataFrame, parts: int, entries: int, dim: int) -> DataFrame:
    """(part, entry, place, total): what the parts that changed add to the sums; place 0 counts, the others are components."""
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            for part, q in _blocks(batch, parts, dim):
                new, had = _codes(part.column("code"), parts), part.column("before").is_valid().to_numpy(zero_copy_only=False)
                old = np.zeros_like(new)
                if had.any():
                    old[had] = _codes(part.column("before").drop_null(), parts)
                for p in range(parts):
                    moved = ~had | (old[:, p] != new[:, p])
                    for rows, codes, sign in ((moved, new, 1), (moved & had, old, -1)):
                        at, x = codes[rows, p], q[rows, p]
                        total[p, :, 0] += sign * np.bincount(at, minlength=entries)
                        for j in range(width):  # exact: a block's sums are below 2^53
                            total[p, :, j + 1] += sign * np.bincount(at, x[:, j], minlength=entries).astype(np.int64)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array(i.astype(np.int32)) for i in where), pa.array(total[where])], ["part", "entry", "place", "total"])

    changed = assigned.where(~F.col("before").eqNullSafe(F.col("code"))).select("q", "before", "code")
    return changed.mapInArrow(run, "part int, entry int, place int, total long")


def fit(embeddings: DataFrame, rounds: int = 2, parts: int = 16, entries: int = 64) -> tuple[DataFrame, np.ndarray, int]:
    """The staged rows with their last assignment, the codebooks (part, entry, place) after the rounds, and the length of a vector."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte")
    rows, dim = _integers(embeddings, parts)
    rows = staged(rows, "integers")
    books = _first_entries(rows, parts, entries, dim)
    sums = None
    for _ in range(rounds if books.size else 0):
        last, rows = rows, _assigned(rows, books, dim)
        moved = _contributions(rows, parts, books.shape[1], dim)
        before, all_ = sums, moved if sums is None else sums.unionByName(moved)
        sums = staged(all_.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")), "sums")
        discard(last, *[before] if before is not None else [])
        total = np.zeros((parts, books.shape[1], dim // parts + 1), dtype=np.int64)
        got = sums.toArrow()  # as many rows as the codebooks have numbers
        total[tuple(got.column(c).to_numpy() for c in ("part", "entry", "place"))] = got.column("total").to_numpy()
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
    if sums is not None:
        discard(sums)
    return rows, books, dim


def compress(embeddings: DataFrame, rounds: int = 2, parts: int = 16, entries: int = 64) -> DataFrame:
    """vec_id, code (two hexadecimal digits for each part), error, label_error (summed over equal labels), codebooks_sha256.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those of another
    length than most; a length that `parts` doesn't divide is filled with zeros.  Components beyond what squared
    errors of 62 bits allow (about 500,000 at 64 dimensions) count as that bound.  Rows without vec_id
    are coded but start no entry; repeated rows count each; ties go to the lower index; a label_error
    beyond 64 bits is the greatest there is; other columns are ignored; an empty table gives no rows.
    """
    rows, books, dim = fit(embeddings, rounds, parts, entries)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, q in _blocks(batch, parts, dim):
                codes, error = nearest(q, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = staged(rows.select("vec_id", "label", "q").mapInArrow(run, f"vec_id long, label {label}, code string, error long"), "codes")
    discard(rows)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = staged(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "label-errors")
    # a label may have any share of the rows: each is dealt over salts, to which its one sum is copied
    salted = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    both = dealt.join(salted, dealt["label"].eqNullSafe(salted["_label"]) & (dealt["_salt"] == salted["_salt"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
