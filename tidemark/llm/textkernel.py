"""Byte-level word kernels shared by the corpus operators.

Arrow string columns are looked at as flat UTF-8 buffers, and words are found and hashed with
vectorised numpy.  All separators are ASCII, so byte positions never split a character.  Memory
follows the block size (``BLOCK`` bytes of text at a time), not the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 entries that marks the given inclusive byte ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are `[^\x20\x09-\x0D]+`.
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
NON_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class _Family:
    """One polynomial hash of byte strings: its base, values of bytes, and powers of the base and its inverse as far as they were needed."""

    def __init__(self, base: int, salt: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.bytes = mix(np.arange(1, 257, dtype=np.uint64) * _U(salt))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 4096)
            up, down = np.full(size, self.base, dtype=np.uint64), np.full(size, self.inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_FAMILIES = (_Family(0x9E3779B97F4A7C15, 0x9FB21C651E98DF25), _Family(0xD1342543DE82EF95, 0xAF251AF3B0F025B5))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and row offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about `limit` bytes, at least one row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def find_words(buffer: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the row each belongs to; no word spans two rows."""
    size = len(buffer)
    if not size:
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~apart[buffer]
    before, after = np.empty(size, dtype=bool), np.empty(size, dtype=bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans that are in order and do not overlap; the two families are independent."""
    out, i, of = np.empty(len(starts), dtype=np.uint64), 0, _FAMILIES[family]
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK, side="left")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = of.powers(high - low + 1)
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(of.bytes[buffer[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def gram_hashes(words: np.ndarray, size: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hashes of all runs of `size` consecutive word hashes, by doubling."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, part, width, scale = np.zeros(count, dtype=np.uint64), 0, words, 1, base | 1
    while True:
        if size & width:
            out = out + part[done : done + count] * _U(pow(base | 1, done, 1 << 64))
            done += width
        width *= 2
        if width > size:
            return mix(out)
        part = part[: len(part) - width // 2] + part[width // 2 :] * _U(scale)
        scale = scale * scale % (1 << 64)


class Tally:
    """Counts of 64-bit keys with bounded memory: `drain` gives what has piled up."""

    def __init__(self, limit: int = 1 << 20) -> None:
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if len(keys):
            if counts is None:
                keys, counts = np.unique(keys, return_counts=True)
            self.parts.append((keys, counts.astype(np.int64)))
            self.size += len(keys)
            if self.size > 2 * self.limit:
                self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.parts = [(keys[first], np.add.reduceat(counts, first))]
        self.size = len(first)

    def drain(self, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size and (whole or self.size > self.limit):
            self._merge()
            if whole or self.size > self.limit:
                yield self.parts[0]
                self.parts, self.size = [], 0
