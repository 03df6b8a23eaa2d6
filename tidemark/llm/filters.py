"""Bloom filters of 64-bit keys, made where the keys are.

A filter has 8 to 16 bits for each key, up to `MOST_BITS` (32 MB); with more keys it lets more of the rest
through, which costs whoever asks it exact comparisons and changes no result.  So what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = 64
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_U = np.uint64


def _places(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each key and its two bits there; a segment has 2^width bits."""
    mask = _U((1 << width) - 1)
    return (h >> _U(58)).astype(np.int64), (h & mask).astype(np.int64), ((h >> _U(width)) & mask).astype(np.int64)


def bloom(keys: DataFrame) -> np.ndarray:
    """Bit table (segment, byte) of the keys in column `h`; a task makes whole segments from the keys as they come."""
    width = _width(keys.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            s, a, b = _places(batch.column("h").to_numpy().view(_U), width)
            for k in np.unique(s).tolist():
                one = made.setdefault(k, np.zeros(1 << width, dtype=bool))
                one[a[s == k]] = one[b[s == k]] = True
        for k, one in made.items():
            yield _segment(k, one)

    return _table(keys.select("h").repartition(F.shiftrightunsigned("h", 58)).mapInArrow(run, "s long, bits binary"), width)


def bloom_of_ranges(rows: DataFrame, ranges: int, unpacked: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The same of keys that are packed by ranges (a power of two) of their highest bits, in rows (bucket, data)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(unpacked(x.as_py())) for x in batch.column(0))], pa.int64())], ["n"])

    width = _width(rows.select("data").mapInArrow(sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            for data in batch.column(1):
                s, a, b = _places(unpacked(data.as_py()), width)
                for k in np.unique(s).tolist():
                    if k not in made:  # ranges are in order
                        yield from (_segment(*x) for x in made.items())
                        made = {k: np.zeros(1 << width, dtype=bool)}
                    made[k][a[s == k]] = made[k][b[s == k]] = True
        yield from (_segment(*x) for x in made.items())

    of = F.shiftright("bucket", max(0, (ranges // SEGMENTS).bit_length() - 1))
    return _table(rows.select("bucket", "data").repartition(of).sortWithinPartitions("bucket").mapInArrow(run, "s long, bits binary"), width)


def _width(count: int) -> int:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * count).bit_length()))
    return (bits // SEGMENTS).bit_length() - 1


def _segment(k: int, one: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(one, bitorder="little").tobytes()])], ["s", "bits"])


def _table(segments: DataFrame, width: int) -> np.ndarray:
    out = np.zeros((SEGMENTS, 1 << width >> 3), dtype=np.uint8)
    for row in segments.toLocalIterator():
        out[row.s] |= np.frombuffer(row.bits, dtype=np.uint8)
    return out


def maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    s, a, b = _places(h, (8 * table.shape[1]).bit_length() - 1)
    has = lambda x: (table[s, x >> 3] >> (x & 7).astype(np.uint8)) & 1
    return (has(a) & has(b)).astype(bool)
