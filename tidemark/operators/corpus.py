"""Corpus preparation: exact and near duplicates, chunks, byte-pair encoding, chat rendering, token shards."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.operators.staging import remove, staged

PERMUTATIONS, BANDS = 128, 16
# Bytes of text that are encoded at once.
ENCODED = 8 << 20


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The smallest doc_id of each text."""
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def minhash_bands(docs: DataFrame, width: int = 5, perms: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """(doc_id, band, bucket): hashes of the bands of a MinHash signature over distinct word shingles."""
    rng = np.random.default_rng(0)
    scale, shift = rng.integers(1, 1 << 63, perms, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, perms, dtype=np.uint64)

    def signature(text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        grams = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
        h = np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), dtype=np.uint64, count=len(grams))
        low = np.full(perms, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(h), 4096):
            low = np.minimum(low, (h[i : i + 4096, None] * scale + shift).min(axis=0))
        return low

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, b, xxhash.xxh64_intdigest(part.tobytes()) - (1 << 63)) for i, t in zip(frame["doc_id"], frame["text"], strict=True) for b, part in enumerate(np.split(signature(t), bands))]
            yield pd.DataFrame(rows, columns=["doc_id", "band", "bucket"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, band int, bucket long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keeper): the smallest doc_id that collisions of bands connect a document with.

    Components stand in for greedy first-wins, which depends on arrival order.  Each band bucket links its members
    to its smallest one, never all pairs; labels are passed on until nothing changes,
    and each round also takes the label of the label, so that long chains take few rounds.
    """
    bands = minhash_bands(docs).persist()
    hub = bands.groupBy("band", "bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    links = bands.join(hub, ["band", "bucket"]).where("doc_id <> hub").select("doc_id", "hub").distinct()
    edges = links.unionByName(links.select(F.col("hub").alias("doc_id"), F.col("doc_id").alias("hub"))).checkpoint()
    labels = docs.select("doc_id", F.col("doc_id").alias("keeper"))
    while True:
        heard = edges.join(labels.withColumnRenamed("doc_id", "hub"), "hub").groupBy("doc_id").agg(F.min("keeper").alias("heard"))
        near = labels.join(heard, "doc_id", "left").withColumn("near", F.least("keeper", "heard"))
        far = labels.groupBy(F.col("doc_id").alias("near")).agg(F.min("keeper").alias("far"))
        best = F.least("near", "far")
        new = near.join(far, "near", "left").select("doc_id", best.alias("keeper"), (best < F.col("keeper")).alias("moved")).checkpoint()
        labels = new.select("doc_id", "keeper")
        if not new.where("moved").head(1):
            break
    bands.unpersist()
    return labels


def chunk_text(text: str, target: int = 256, overlap: int = 40, size: Callable[[str], int] | None = None) -> list[tuple[str, int, int, str]]:
    """(text, start, end, heading path) chunks of one document: sections by headings, paragraphs, then sentences, packed greedily.

    `size` counts a text's tokens (a quarter of its characters); the tail of a chunk is repeated in the next up to
    `overlap`.  start and end are where the chunk's first piece starts and its last one ends.
    """
    size = size or (lambda s: max(1, len(s) // 4))

    def cut(body: str, at: int, pattern: str) -> list[tuple[str, int]]:
        edges = [0, *[x for m in re.finditer(pattern, body) for x in m.span()], len(body)]
        pieces = [(body[a:b], at + a) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        return [(p, o) for p, o in pieces if p.strip()]

    heads = list(re.finditer(r"^(#{1,6})\s+(.*)$", text, re.MULTILINE))
    sections, path = [("", text[: heads[0].start()] if heads else text, 0)], []
    for head, end in zip(heads, [*[h.start() for h in heads[1:]], len(text)], strict=False):
        path = [*path[: len(head[1]) - 1], head[2].strip()]
        sections.append((" > ".join(path), text[head.end() : end], head.end()))
    out: list[tuple[str, int, int, str]] = []
    for heading, body, base in sections:
        units = [u for p, o in cut(body, base, r"\n\s*\n") for u in ([(p, o)] if size(p) <= target else cut(p, o, r"(?<=[.!?])\s+(?=[A-Z(\"'\[])"))]
        held: list[tuple[str, int]] = []

        def close(held=held, heading=heading) -> None:
            whole = "\n\n".join(p for p, _ in held).strip()
            if whole:
                out.append((whole, held[0][1], held[-1][1] + len(held[-1][0]), heading))

        for piece, at in units:
            if held and sum(size(p) for p, _ in held) + size(piece) > target:
                close()
                tail = 0
                while tail < len(held) and sum(size(p) for p, _ in held[len(held) - tail :]) < overlap:
                    tail += 1
                del held[: len(held) - tail]
            held.append((piece, at))
        close()
    return out


def chunks(docs: DataFrame, target: int = 256, overlap: int = 40, size: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, chunk_id, text, start_char, end_char, heading); rows are independent, nothing is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, f"{i}#{n}", *c) for i, t in zip(frame["doc_id"], frame["text"], strict=True) for n, c in enumerate(chunk_text(t or "", target, overlap, size))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "text", "start_char", "end_char", "heading"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_id string, text string, start_char int, end_char int, heading string")


@F.udtf(returnType="chunk_id int, text string, start_char int, end_char int, heading string")
class ChunkTable:
    """Table function: the chunks of a text (`spark.udtf.register`, then lateral joins in SQL)."""

    def eval(self, text: str, target: int, overlap: int) -> Iterator[tuple]:
        for n, (chunk, start, end, heading) in enumerate(chunk_text(text or "", target, overlap)):
            yield n, chunk, start, end, heading


def replace_document(index: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with those of the documents in `new` replaced."""
    return index.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


WORD = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def word_counts(docs: DataFrame) -> DataFrame:
    """Pre-tokens and their counts: all that training merges needs of the corpus."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent character pairs weighted by word counts: the first round of merging."""
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))
    return words.select("n", chars.alias("c")).where(F.size("c") > 1).select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a batch's words, -1 after each word, and the count of its word beside each."""
    for batch in batches:
        words = [(w or "").encode() for w in batch.column("word").to_pylist()]
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        ids = np.frombuffer(b"".join(w + b"\0" for w in words), dtype=np.uint8).astype(np.int32)
        ids[np.cumsum(sizes) - 1] = -1
        n = np.repeat(batch.column("n").to_numpy().astype(np.int64), sizes)
        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["ids", "n"])


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of at most `most` bytes, or one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right")))
        yield texts.slice(start, end - start)
        start = end


def _alternate(at: np.ndarray) -> np.ndarray:
    """Every other one of places that follow each other: a pair of equal tokens can't overlap itself."""
    start = np.r_[True, np.diff(at) != 1]
    return at[(at - at[start][np.cumsum(start) - 1]) % 2 == 0] if len(at) else at


def _merged(ids: np.ndarray, n: np.ndarray, merges: list[tuple[int, int]], new: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed words after merges, the first of which makes the token `new`."""
    for k, (a, b) in enumerate(merges):
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
        if not len(at):
            continue
        if a == b:
            at = _alternate(at)
        ids = ids.copy()
        ids[at] = new + k
        keep = np.ones(len(ids), dtype=bool)
        keep[at + 1] = False
        ids, n = ids[keep], n[keep]
    return ids, n


def _codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of adjacent pairs within words, and the pairs as numbers."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at].astype(np.int64) << 32 | ids[at + 1]


def _tokens_of(ids: np.ndarray) -> np.ndarray:
    """Tokens of each packed word."""
    return np.diff(np.r_[-1, np.flatnonzero(ids < 0)]) - 1


def _of_words(ids: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed words that `which` marks."""
    inside = np.repeat(which, _tokens_of(ids) + 1)
    return ids[inside], n[inside]


def _pair_sums(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    code, back = np.unique(code, return_inverse=True)
    total = np.zeros(len(code), dtype=np.int64)
    np.add.at(total, back, n)
    return pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], ["a", "b", "n"])


class _PairIndex:
    """Packed words in blocks with the pairs that each block has: merges pass by blocks without their pairs.

    Words lie in order of their text, so that rare pairs are in few blocks.  Merges since the last `settle` are applied when
    a block is read; `settle` writes the words as they are then, without those of one token, and their pairs again.
    """

    def __init__(self, words: DataFrame) -> None:
        packed = words.select("word", F.col("n").cast("long").alias("n")).repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_packed, "ids binary, n binary")
        self.state, self.new = self._written(packed, [], 256), 256
        self.waiting: list[tuple[int, int]] = []

    def _written(self, blocks: DataFrame, merges: list[tuple[int, int]], new: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed, weights in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    ids, n = _merged(np.frombuffer(packed, dtype=np.int32), np.frombuffer(weights, dtype=np.int64), merges, new)
                    ids, n = _of_words(ids, n, _tokens_of(ids) > 1)
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, n, np.unique(_codes(ids)[1]))], ["ids", "n", "pairs"])

        return staged(blocks.mapInArrow(run, "ids binary, n binary, pairs binary"), "bpe-words")

    def settle(self) -> None:
        old, self.state = self.state, self._written(self.state, self.waiting, self.new)
        remove(old.sparkSession, old._staged_at)
        self.new, self.waiting = self.new + len(self.waiting), []

    def close(self) -> None:
        remove(self.state.sparkSession, self.state._staged_at)

    def counts(self) -> DataFrame:
        """(a, b, n) of all pairs."""
        waiting, new = list(self.waiting), self.new

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed, weights in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    ids, n = _merged(np.frombuffer(packed, dtype=np.int32), np.frombuffer(weights, dtype=np.int64), waiting, new)
                    at, code = _codes(ids)
                    yield _pair_sums(code, n[at])

        return self.state.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))

    def merge(self, merges: list[tuple[int, int]]) -> DataFrame:
        """Take in further merges: (a, b, n), by how much the counts of pairs change, from the words that change alone."""
        before, new = list(self.waiting), self.new
        self.waiting += merges
        wanted = np.array(sorted(a << 32 | b for a, b in self.waiting), dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    if not np.isin(wanted, np.frombuffer(batch.column("pairs")[i].as_py(), dtype=np.int64), assume_unique=True).any():
                        continue
                    ids, n = (np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in (("ids", np.int32), ("n", np.int64)))
                    ids, n = _merged(ids, n, before, new)
                    after, m = _merged(ids, n, merges, new + len(before))
                    changed = _tokens_of(ids) != _tokens_of(after)
                    if changed.any():
                        (ids, n), (after, m) = _of_words(ids, n, changed), _of_words(after, m, changed)
                        (at, gone), (to, made) = _codes(ids), _codes(after)
                        yield _pair_sums(np.r_[gone, made], np.r_[-n[at], m[to]])

        return self.state.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


class Bpe:
    """Byte-level byte-pair encoding; merges in order of their ranks."""

    KEEP = 1 << 18

    def __init__(self, merges: list[tuple[int, int]], specials: tuple[str, ...] = ()) -> None:
        self.merges, self.specials = merges, specials
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.bytes = [bytes([i]) for i in range(256)]
        for a, b in merges:
            self.bytes.append(self.bytes[a] + self.bytes[b])
        self.special_ids = {s: len(self.bytes) + i for i, s in enumerate(specials)}
        self.cache: dict[str, list[int]] = {}

    @property
    def vocab_size(self) -> int:
        return len(self.bytes) + len(self.specials)

    @classmethod
    def train(cls, words: DataFrame, vocab_size: int, min_count: int = 2, specials: tuple[str, ...] = ()) -> Bpe:
        """Merges learnt from all pre-tokens, which stay distributed.

        The driver holds the `KEEP` most frequent pairs.  Merging makes counts of old pairs smaller only, and those of new
        pairs are known when they are made, so a pair below the last that is held can't come before it: what has changed is
        all that a round needs (`_PairIndex.merge`).  When the pairs held are used up, all are counted again.  A
        round takes pairs in order of their counts as long as no earlier merge can change what is next.
        """
        index, merges, room = _PairIndex(words), [], vocab_size - 256 - len(specials)
        held, least = cls._most(index, min_count)
        while len(merges) < room:
            taken = cls._next(sorted(((n, pair) for pair, n in held.items()), reverse=True))[: room - len(merges)]
            if not taken:
                if least <= min_count:
                    break
                held, least = cls._most(index, min_count)
                continue
            first_new = 256 + len(merges)
            merges += taken
            for r in index.merge(taken).toLocalIterator():
                pair, n = (r.a, r.b), held.get((r.a, r.b), 0) + r.n
                if n >= least and (pair in held or max(pair) >= first_new):
                    held[pair] = n
                else:
                    held.pop(pair, None)
            if len(index.waiting) >= 64:
                index.settle()
        index.close()
        return cls(merges, specials)

    @classmethod
    def _most(cls, index: _PairIndex, min_count: int) -> tuple[dict[tuple[int, int], int], int]:
        """The most frequent pairs with their counts, and the count from which on they are all there."""
        rows = index.counts().where(F.col("n") >= min_count).orderBy(F.desc("n")).limit(cls.KEEP + 1).collect()
        least = min_count if len(rows) <= cls.KEEP else rows[-1].n + 1
        if rows and least > rows[0].n:  # more pairs than are held have the greatest count
            least = rows[0].n
            rows = index.counts().where(F.col("n") >= least).collect()
        return {(r.a, r.b): r.n for r in rows if r.n >= least}, least

    @staticmethod
    def _next(pairs: list[tuple[int, tuple[int, int]]]) -> list[tuple[int, int]]:
        """The first pairs that are merged one after the other whatever the merges before them make.

        A pair made by merging (a, b) occurs no more often than some (x, a) or (b, x) did, so it can come next only
        when such a pair is reached, or has the count that is reached.
        """
        taken: list[tuple[int, int]] = []
        first, second = set(), set()
        touched = lambda p: p[0] in second or p[1] in first
        at = 0
        while at < len(pairs):
            tied = at
            while tied < len(pairs) and pairs[tied][0] == pairs[at][0]:
                tied += 1
            for k in range(at, tied):
                if taken and any(touched(p) for _, p in pairs[k:tied]):
                    return taken
                taken.append(pairs[k][1])
                first.add(pairs[k][1][0])
                second.add(pairs[k][1][1])
                if pairs[k][1][0] == pairs[k][1][1]:
                    return taken
            at = tied
        return taken

    @staticmethod
    def _joined(s: list[int], pair: tuple[int, int], new: int) -> list[int]:
        out, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                out.append(new)
                i += 2
            else:
                out.append(s[i])
                i += 1
        return out

    def encode(self, text: str) -> list[int]:
        import regex

        out: list[int] = []
        for word in regex.findall(WORD, text):
            ids = self.cache.get(word)
            if ids is None:
                ids = list(word.encode())
                while len(ids) > 1:
                    pair = min(zip(ids, ids[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
                    if pair not in self.rank:
                        break
                    ids = self._joined(ids, pair, 256 + self.rank[pair])
                if len(self.cache) < 1 << 18:
                    self.cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        names = {v: k.encode() for k, v in self.special_ids.items()}
        return b"".join(names[i] if i in names else self.bytes[i] for i in ids).decode(errors="replace")

    def column(self, text: Column) -> Column:
        """Ids of a text column, by Arrow batches; the merges travel with the function (at most the vocabulary)."""
        merges, specials = self.merges, self.specials

        @F.arrow_udf(ArrayType(IntegerType()))
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = Bpe(merges, specials)
            for batch in batches:
                parts = [own.encode_all(part) for part in _slices(batch, ENCODED)]
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

        return ids(text)

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Lists of ids as `encode` gives them, null for null; each distinct word is merged once, all words together."""
        import regex

        find = regex.compile(WORD).findall
        words: list[str] = []
        ends = [0]
        for t in texts.to_pylist():
            words += find(t) if t else ()
            ends.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        values = self._of_words(coded.dictionary).take(coded.indices)
        offsets = values.offsets.to_numpy()[np.array(ends)] - values.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values.flatten(), mask=texts.is_null())

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words: in each round, every word that has a pair merges its first-ranked one wherever it stands."""
        none = len(self.merges)
        order = sorted(self.rank)
        code = np.array([a << 32 | b for a, b in order], dtype=np.int64)
        rank = np.array([self.rank[p] for p in order] + [none], dtype=np.int64)
        encoded = [w.encode() for w in words.to_pylist()]
        ids = np.frombuffer(b"".join(w + b"\0" for w in encoded), dtype=np.uint8).astype(np.int32)
        ids[np.cumsum([len(w) + 1 for w in encoded], dtype=np.int64) - 1] = -1
        number, done = np.arange(len(encoded)), []
        while len(number):
            at, pairs = _codes(ids)
            place = np.minimum(np.searchsorted(code, pairs), none and len(code) - 1)
            of = np.full(len(ids), none, dtype=np.int64)
            of[at] = np.where(code[place] == pairs, rank[place], none) if len(code) else none
            sizes = _tokens_of(ids) + 1
            first = np.minimum.reduceat(of, np.cumsum(sizes) - sizes)
            over = first == none
            if over.any():
                done.append((number[over], sizes[over] - 1, ids[np.repeat(over, sizes) & (ids >= 0)]))
                left = np.repeat(~over, sizes)
                ids, of, sizes, number, first = ids[left], of[left], sizes[~over], number[~over], first[~over]
            at = _alternate(np.flatnonzero(of == np.repeat(first, sizes)))
            ids[at] = 256 + of[at]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids = ids[keep]
        if not done:
            return pa.array([], pa.list_(pa.int32()))
        number, sizes, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, pa.int32()))
        return lists.take(pa.array(np.argsort(number)))


def render_chat(conversations: DataFrame) -> DataFrame:
    """One rendered string for each conversation, turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>"), t["text"])), "")
    return conversations.groupBy("conv_id").agg(F.concat(F.lit("<|bos|>"), body, F.lit("<|eos|>")).alias("rendered"), F.count("*").alias("n_turns"))


def loss_mask(conversations: DataFrame, length: Column) -> DataFrame:
    """Token totals and trained tokens: bodies of assistant turns, and the end token; `length` counts a turn's tokens."""
    own = F.when(F.col("role") == "assistant", length).otherwise(0)
    return conversations.groupBy("conv_id").agg((F.sum(length + 1) + 2).alias("n_tokens"), (F.sum(own) + 1).alias("n_trained"))


def evidence_prompt(evidence: DataFrame) -> DataFrame:
    """Grounded prompts: evidence(query_id, question, n, source, date, tier, text) in order of n."""
    line = lambda e: F.concat(F.lit("<|evidence|>[E"), e["n"].cast("string"), F.lit("] source="), e["source"], F.lit(" date="), F.coalesce(e["date"], F.lit("unknown")), F.lit(" tier="), e["tier"].cast("string"), F.lit("\n"), e["text"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "source", "date", "tier", "text"))), line), "\n")
    ask = "\nAnswer using only the evidence above. Cite [E#] after each claim. If the evidence is insufficient or conflicting, say so explicitly."
    return evidence.groupBy("query_id").agg(F.concat(lines, F.lit("\n\nQuestion: "), F.first("question"), F.lit(ask)).alias("prompt"))


def training_examples(conversations: DataFrame, bpe: Bpe, max_len: int) -> DataFrame:
    """(conv_id, ids, mask, n): turns in order as ids, padded or cut to `max_len`; mask is 1 for what assistants say and the end.

    `bpe` needs the specials <|bos|>, <|eos|>, <|pad|> and <|role|> for each role; a role without one is refused.
    """
    special = bpe.special_ids
    roles = F.create_map(*[F.lit(x) for name, i in special.items() for x in (name, i)])
    marker = roles[F.concat(F.lit("<|"), F.col("role"), F.lit("|>"))]
    own = F.when(F.col("role") == "assistant", 1).otherwise(0)
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), bpe.column(F.coalesce("text", F.lit(""))).alias("body"))
    turns = turns.withColumn("marker", F.coalesce(marker, F.raise_error(F.concat(F.lit("no special for role "), F.col("role"))).cast("int")))
    each = turns.select(
        "conv_id", F.struct("turn", "role", "text", F.concat(F.array("marker"), "body").alias("ids"), F.concat(F.array(F.lit(0)), F.transform("body", lambda _: own)).alias("mask")).alias("t")
    )
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    joined = lambda name, first, last: F.concat(F.array(F.lit(first)), F.flatten(F.transform("turns", lambda t: t[name])), F.array(F.lit(last)))
    out = whole.select("conv_id", joined("ids", special["<|bos|>"], special["<|eos|>"]).alias("ids"), joined("mask", 0, 1).alias("mask"))
    fill = lambda c, value: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(value), F.greatest(F.lit(0), max_len - F.size(c)))), 1, max_len)
    return out.select("conv_id", fill("ids", special["<|pad|>"]).alias("ids"), fill("mask", 0).alias("mask"), F.least(F.size("ids"), F.lit(max_len)).alias("n"))


def _running(docs: DataFrame, size: str, buckets: int) -> DataFrame:
    """With `_upto`, the running total in order of doc_id (within ranges, then over range totals), and `_all`."""
    ranged = docs.repartitionByRange(buckets, "doc_id").withColumn("_p", F.spark_partition_id())
    inside = F.sum(size).over(Window.partitionBy("_p").orderBy("doc_id"))
    totals = ranged.groupBy("_p").agg(F.sum(size).alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    joined = ranged.withColumn("_in", inside).join(F.broadcast(before), "_p")  # at most `buckets` rows
    return joined.withColumn("_upto", F.coalesce("_before", F.lit(0)) + F.col("_in")).drop("_p", "_in", "_n", "_before")


def write_shards(ids: DataFrame, path: str, tokens: int, buckets: int = 256) -> DataFrame:
    """Write ids(doc_id, ids) in order of doc_id to folders of about `tokens` tokens each; (shard, n_docs, n_tokens) of what was written."""
    sized = _running(ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n")), "n", buckets)
    shard = F.floor((F.col("_upto") - F.col("n")) / tokens).cast("int")
    sized.select("doc_id", "ids", shard.alias("shard")).repartition("shard").sortWithinPartitions("shard", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(path)
    back = ids.sparkSession.read.parquet(path)
    return back.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"))


def tail_split(docs: DataFrame, size: str, share: float = 0.01, buckets: int = 256) -> DataFrame:
    """Mark the last `share` of the tokens, in order of doc_id, as validation."""
    split = F.when(F.col("_upto") > (1 - share) * F.col("_all"), "val").otherwise("train")
    return _running(docs, size, buckets).withColumn("split", split).drop("_upto", "_all")


def token_windows(ids: DataFrame, length: int, per_doc: int = 1, seed: int = 0) -> DataFrame:
    """Training windows of ids(doc_id, ids): inputs `x` and targets `y`, shifted by one; starts follow from a hash of document and draw.

    Documents of fewer than length + 1 tokens give none, so a window never crosses documents.
    """
    room = F.size("ids") - length
    rows = ids.where(room >= 1).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))))
    start = F.pmod(F.xxhash64("doc_id", "draw", F.lit(seed)), room).cast("int")
    rows = rows.withColumn("start", start)
    return rows.select("doc_id", "draw", "start", F.slice("ids", F.col("start") + 1, F.lit(length)).alias("x"), F.slice("ids", F.col("start") + 2, F.lit(length)).alias("y"))
