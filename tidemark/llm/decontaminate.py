"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' normalised words.  A training text's words are streamed through it
and the longest match that ends at each word is tracked: where it reaches `width` words (or a whole item that
is shorter), the words of the match are hit.  Only runs of words whose neighbours also stand side by side in
some item can hold a match that long, so the automaton is walked on those runs alone; they are found with
vectorised look-ups of word and pair hashes, and the walk compares the words themselves.

Test items are few beside a corpus, but their number isn't taken on trust: they are read in blocks of at
most `BLOCK_WORDS` words (or one item), each with an automaton of at most twice as many states that is broadcast.
The driver holds one block while the texts are matched with it, and lets it go when the next is due; what a block
has hit is staged and brought together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.store import discard, documents_of, staged, unused

WIDTH = 10
BLOCK_WORDS = 100_000


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of one text."""
    block = K.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    starts, ends, _ = K.find_words(block, np.array([0, len(block)]), K.NON_WORD)
    data = block.tobytes()
    return [data[a:b] for a, b in zip(starts, ends, strict=True)]


@dataclass
class Automaton:
    """States by number: transitions, suffix link, longest length, and the windows that end there."""

    width: int = WIDTH
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, dict[int, set[int]]] = field(default_factory=dict)  # state -> length -> items
    up: list[int] = field(default_factory=list)
    least: int = WIDTH

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state for what `p` then `symbol` spells, split off from its target if that holds longer strings only."""
        q = self.step[p][symbol]
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(symbol) == q:
            self.step[p][symbol] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.step[last]:
            return self._split(last, symbol)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.step[p]:
            self.step[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol)
        return new

    def walk(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest match after one more word (-1: a word of no item)."""
        while state and symbol not in self.step[state]:
            state = self.link[state]
            matched = self.length[state]
        if symbol in self.step[state]:
            return self.step[state][symbol], matched + 1
        return 0, 0

    def ending(self, state: int, matched: int) -> Iterator[tuple[int, set[int]]]:
        """(length, items) of the windows that are suffixes of the match."""
        state = self.up[state]
        while state > 0:
            for size, items in self.windows[state].items():
                if size <= matched:
                    yield size, items
            state = self.up[self.link[state]]

    @classmethod
    def of(cls, items: list[tuple[int, list[bytes]]], width: int = WIDTH) -> Automaton:
        out, coded = cls(width=width, least=width), []
        for item, words in items:
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for symbol in ids:
                    last = out._extend(last, symbol)
        for item, ids in coded:
            size, state, matched = min(width, len(ids)), 0, 0
            out.least = min(out.least, size)
            for i, symbol in enumerate(ids):
                state, matched = out.walk(state, matched, symbol)
                if i + 1 >= size:
                    at = state
                    while out.length[out.link[at]] >= size:
                        at = out.link[at]
                    out.windows.setdefault(at, {}).setdefault(size, set()).add(item)
        out.up = [0] * len(out.length)
        for state in sorted(range(1, len(out.length)), key=out.length.__getitem__):
            out.up[state] = state if state in out.windows else out.up[out.link[state]]
        return out


class Matcher:
    """An automaton with the sorted hashes that find the runs worth walking."""

    def __init__(self, automaton: Automaton, pairs: set[tuple[int, int]]) -> None:
        self.automaton, words = automaton, list(automaton.vocabulary)
        ends = np.cumsum([len(w) for w in words] or [0])
        hashes = K.hash_spans(np.frombuffer(b"".join(words), dtype=np.uint8), np.r_[0, ends[:-1]], ends) if words else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order.astype(np.int64)
        self.pairs = np.sort(np.array([a << 32 | b for a, b in pairs], dtype=np.int64))

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def match(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and the items found in each row."""
        hit, found = np.zeros(len(starts), dtype=bool), {}
        ids = self._ids(K.hash_spans(block, starts, ends))
        joined = np.zeros(len(ids) + 1, dtype=bool)  # joined[i]: words i - 1 and i stand side by side in an item
        if len(ids) > 1 and len(self.pairs):
            both = np.flatnonzero((rows[1:] == rows[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
            code = ids[both] << 32 | ids[both + 1]
            at = np.searchsorted(self.pairs, code)
            at[at == len(self.pairs)] = 0
            joined[both[self.pairs[at] == code] + 1] = True
        first = np.flatnonzero((ids >= 0) & ~joined[:-1])
        last = np.flatnonzero((ids >= 0) & ~joined[1:]) + 1
        long = last - first >= self.automaton.least
        vocabulary, walk = self.automaton.vocabulary, self.automaton.walk
        for a, b in zip(first[long], last[long], strict=True):
            state = matched = 0
            for i in range(a, b):
                state, matched = walk(state, matched, vocabulary.get(block[starts[i] : ends[i]].tobytes(), -1))
                for size, items in self.automaton.ending(state, matched):
                    hit[i + 1 - size : i + 1] = True
                    found.setdefault(int(rows[i]), set()).update(items)
        return hit, found


def matchers(benchmark: DataFrame, width: int = WIDTH) -> Iterator[Matcher]:
    """A matcher for each block of items, one after the other; null texts are left out."""

    def made(block: list[tuple[int | None, list[bytes]]]) -> Matcher:
        automaton = Automaton.of(block, width)
        ids = [[automaton.vocabulary[w] for w in words] for _, words in block]
        return Matcher(automaton, {p for x in ids for p in zip(x[:-1], x[1:], strict=True)})

    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        words = words_of(row.text)
        if block and size + len(words) > BLOCK_WORDS:
            yield made(block)
            block, size = [], 0
        block.append((row.item_id, words))
        size += len(words)
    yield made(block)


def _matched(batch: pa.RecordBatch, matcher: Matcher) -> Iterator[tuple]:
    """Blocks of whole rows: first and last row, bytes, word starts, ends and rows, hits, items."""
    buffer, offsets = K.text_buffer(batch.column("text"))
    for a, b in K.row_blocks(offsets):
        raw, at = buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        block = K.LOWER[raw]
        starts, ends, rows = K.find_words(block, at, K.NON_WORD)
        hit, found = matcher.match(block, starts, ends, rows)
        yield a, b, raw, at, starts, ends, rows, hit, found


def _runs(hit: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last word of the runs of hit words of one row."""
    edge = np.r_[False, hit, False]
    apart = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(hit & (~edge[:-2] | apart))
    last = np.flatnonzero(hit & (~edge[2:] | np.r_[apart[1:], True][: len(hit)])) + 1
    return first, last


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    A null text has no words; items of null texts and without words match nothing; items without an item_id hit
    words like others, count as one item together and have no name in the digest; repeated rows are repeated;
    other columns are ignored; with an empty benchmark nothing is hit; an empty table gives no rows.
    """
    rows, parts = documents_of(docs).withColumn("text_key", F.xxhash64("text")), []
    shared = None
    for matcher in matchers(benchmark, width):
        if shared is not None:
            parts[-1] = staged(parts[-1], "hits")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, _, _, _, _, rows, hit, found in _matched(batch, shared.value):
                    n = np.bincount(rows, minlength=b - a).astype(np.int64)
                    base = np.cumsum(n) - n
                    first, last = _runs(hit, rows)
                    of = rows[first] if len(first) else first
                    spans: list[list] = [[] for _ in range(b - a)]
                    for r, x, y in zip(of.tolist(), first.tolist(), last.tolist(), strict=True):
                        spans[r].append({"a": x - int(base[r]), "b": y - int(base[r])})
                    items = [sorted(found.get(r, ()), key=lambda i: (i is None, i or 0)) for r in range(b - a)]
                    part = batch.slice(a, b - a)
                    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("text_key"), pa.array(n), pa.array(spans, span_type), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_words", "hits", "items"]
                    )

        parts.append(rows.mapInArrow(run, "doc_id long, text_key long, n_words long, hits array<struct<a:int,b:int>>, items array<long>"))
    got = parts[0]
    if len(parts) > 1:
        for other in parts[1:]:
            got = got.unionByName(other)
        got = got.groupBy("doc_id", "text_key").agg(
            F.max("n_words").alias("n_words"), (F.count("*") / len(parts)).cast("int").alias("m"), F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"), F.flatten(F.collect_set("items")).alias("items")
        )
        got = got.withColumn("copy", F.explode(F.sequence(F.lit(1), "m")))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["b"]).alias("upto"), (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["upto"]), F.lit(0))).alias("n"))
    names = F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string"))))
    return got.select("doc_id", "n_words", F.aggregate("hits", start, step, lambda s: s["n"]).alias("n_hit"), names.alias("names")).select(
        "doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_coverage: float = 0.8) -> DataFrame:
    """The input rows without the spans that match an item over `width` words (or a whole shorter item).

    A span goes from its first to its last word; rows of which more than `max_coverage` of the words are hit go
    as a whole.  n_chars, where there is one, follows.  Rows without a hit are unchanged, null texts too.
    Each block of items is matched with the whole text; a bit for each hit word goes on, staged, to the next block,
    and the last one cuts.
    """
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spark, hits_ = docs.sparkSession, unused("hits", docs)
    docs, blocks = docs.withColumn(hits_, F.lit(None).cast("binary")), matchers(benchmark, width)
    matcher, staged_before = next(blocks), None
    while matcher is not None:
        shared, following = spark.sparkContext.broadcast(matcher), next(blocks, None)
        last_block = following is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last_block=last_block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                earlier, batch = batch.column(len(columns)), batch.select(columns)
                for a, b, raw, at, starts, ends, rows, hit, _ in _matched(batch, shared.value):
                    part = batch.slice(a, b - a)
                    upto = np.cumsum(np.bincount(rows, minlength=b - a))
                    spans = list(zip(np.r_[0, upto[:-1]].tolist(), upto.tolist(), strict=True))
                    for (x, y), bits in zip(spans, earlier.slice(a, b - a).to_pylist(), strict=True):
                        if bits is not None:
                            hit[x:y] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=y - x).astype(bool)
                    if not last_block:
                        marks = [np.packbits(hit[x:y]).tobytes() if hit[x:y].any() else None for x, y in spans]
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.binary())], [*columns, hits_])
                        continue
                    if not hit.any():
                        yield part
                        continue
                    words, hits = np.bincount(rows, minlength=b - a), np.bincount(rows[hit], minlength=b - a)
                    first, last = _runs(hit, rows)
                    texts = part.column("text").to_pylist()
                    touched = np.flatnonzero(hits)
                    for r in touched:
                        pieces, upto = [], at[r]
                        for x, y in zip(first[rows[first] == r], last[rows[first] == r], strict=True):
                            pieces.append(raw[upto : starts[x]].tobytes())
                            upto = ends[y - 1]
                        pieces.append(raw[upto : at[r + 1]].tobytes())
                        texts[r] = b"".join(pieces).decode()
                    arrays = dict(zip(columns, part.columns, strict=True))
                    arrays["text"] = pa.array(texts, part.column("text").type)
                    if "n_chars" in arrays:
                        n = arrays["n_chars"].to_pylist()
                        for r in touched:
                            n[r] = len(texts[r])
                        arrays["n_chars"] = pa.array(n, arrays["n_chars"].type)
                    keep = pa.array(hits <= max_coverage * words)
                    yield pa.RecordBatch.from_arrays([arrays[c] for c in columns], columns).filter(keep)

        docs = docs.mapInArrow(run, fields if last_block else f"{fields}, `{hits_}` binary")
        if not last_block:
            docs = staged(docs, "hits")
            shared.unpersist()
            if staged_before is not None:
                discard(staged_before)
            staged_before = docs
        matcher = following
    return docs
