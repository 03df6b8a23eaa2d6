"""LM scoring with a probabilistic suffix tree over words.

Every context of up to `depth` words (a text's start is the end token of the one before) and every
continuation that occurs `min_count` times in the training texts is a candidate, whatever the size of the
corpus; a context stays in the tree when its next-word distribution diverges from that of its longest
suffix that stayed (log-likelihood ratio of at least `cutoff`).  Distributions are smoothed towards the
suffix's (Dirichlet prior of `prior` tokens, what is left of the mass is spread over the words not listed).

The tree is a staged table.  In the logarithm, a state adds its `rest` to each token that follows it and
`listed` on top to a continuation it lists, so a text's score is a sum over the keys of its word runs: they
are joined with the table, and nothing that grows with the corpus is collected.  Words and runs that make up
`_FREQUENT` of the tokens or more travel with the texts' tasks, as far as they find a slot in two tables of bounded
size (`CACHE_BITS`); all others are joined, after a Bloom filter of bounded size, made of all runs that travel
with no task, has dropped most runs that the table hasn't.  Words and runs are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.filters import bloom, maybe
from tidemark.llm.store import crc_of, discard, documents_of, small_batches, staged

_I, _U = np.int64, np.uint64
_END, _NONE = _U(0x517CC1B727220A95), _U(1)
_FREQUENT = 5e-7  # words and runs with this share of the tokens needn't be joined
CACHE_BITS = (20, 18)  # slots of a cache's tables, as powers of two


@dataclass
class Frequent:
    """Words with at least `_FREQUENT` of the tokens; id of keys[i] is i + 1, id 0 is the end of a text."""

    keys: np.ndarray
    counts: np.ndarray


@dataclass
class Cache:
    """Values of frequent words or runs: a slot has one key, the most frequent of those that fall into it.

    What loses its slot in the first table has one in the second, by further bits; what loses both is not here and must be joined.
    """

    tables: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, often: DataFrame) -> Cache:
        """From (key, n, v), what reaches the driver is bounded by the number of slots."""
        parts, low, cache = [], 64, cls.made(np.zeros(0, dtype=_U), np.zeros(0, dtype=_I), np.zeros(0))
        for bits in CACHE_BITS:
            low -= bits
            slot = F.shiftrightunsigned("key", low).bitwiseAND((1 << bits) - 1)
            rows = cache.lacking(often) if parts else often
            best = rows.groupBy(slot.alias("slot")).agg(F.max(F.struct("n", "key", "v")).alias("x"))
            parts.insert(0, best.select("x.n", "x.key", "x.v").toArrow())  # of equal counts the last one has the slot
            got = pa.concat_tables(parts)
            cache = cls.made(got.column("key").to_numpy().view(_U), got.column("n").to_numpy(), got.column("v").to_numpy())
        return cache

    @classmethod
    def made(cls, keys: np.ndarray, n: np.ndarray, values: np.ndarray) -> Cache:
        out, order = cls([(np.zeros(1 << bits, dtype=_U), np.zeros(1 << bits)) for bits in CACHE_BITS]), np.argsort(n, kind="stable")
        for own, kept, slots in out._slots():
            slot = slots(keys[order])
            own[slot] = keys[order]
            last = own[slot] == keys[order]
            kept[slot[last]] = values[order][last]
            order = order[~last]
        return out

    def _slots(self) -> Iterator[tuple]:
        """Keys and values of each table, and the slot of a key there."""
        low = 64
        for own, values in self.tables:
            low -= len(own).bit_length() - 1
            yield own, values, lambda keys, low=_U(low), mask=_U(len(own) - 1): keys >> low & mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are here, and their values (0 for others)."""
        here, out, left = np.zeros(len(keys), dtype=bool), np.zeros(len(keys)), slice(None)
        for own, values, slots in self._slots():
            asked = keys[left]
            slot = slots(asked)
            here[left] = found = own[slot] == asked
            out[left] = np.where(found, values[slot], 0.0)
            left = np.flatnonzero(~here)
        return here, out

    def lacking(self, rows: DataFrame) -> DataFrame:
        """The rows whose `key` is not here."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~shared.value.get(batch.column("key").to_numpy().view(_U))[0]))

        return rows.mapInArrow(run, rows.schema)


@dataclass
class Tree:
    """Staged (key, n, listed, rest) of the states that stayed, logarithms to base 10 (a key may have two rows); what travels with tasks."""

    words: Frequent
    root: np.ndarray
    depth: int
    values: DataFrame
    word_cache: Cache
    cache: Cache
    filter: np.ndarray
    levels: list[DataFrame]

    def _stays(self, depth: int) -> np.ndarray:
        return np.array([r.stays for r in self.levels[depth - 1].select("ctx", "stays").distinct().collect()], dtype=bool)

    @property
    def word_stays(self) -> np.ndarray:
        """For each context of one word: did it stay?  (For looking at small trees.)"""
        return self._stays(1)

    @property
    def pair_stays(self) -> np.ndarray:
        return self._stays(2)

    @cached_property
    def collected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table of a small tree, by key."""
        got = self.values.groupBy("key").agg(F.sum("listed").alias("listed"), F.sum("rest").alias("rest")).toPandas()
        keys = got["key"].to_numpy(dtype=_I).view(_U)
        order = np.argsort(keys)
        return keys[order], got["listed"].to_numpy(dtype=float)[order], got["rest"].to_numpy(dtype=float)[order]


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key among sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=_I)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _sequence(words: np.ndarray, rows: np.ndarray, n_rows: int, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with an end token before and after each text; the row of each, and where a text's first token is."""
    per_row = np.bincount(rows, minlength=n_rows)
    at = np.cumsum(per_row + 2) - per_row - 2
    out = np.full(int(per_row.sum()) + 2 * n_rows, end, dtype=words.dtype)
    out[np.arange(len(words)) + 2 * rows + 1] = words
    return out, np.repeat(np.arange(n_rows), per_row + 2), at


def _runs(keys: np.ndarray, row: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to depth + 1 tokens: the key of the run that ends at each token, and is it within one text?"""
    out = [(keys, np.ones(len(keys), dtype=bool))]
    for k in range(1, depth + 1):
        last, key, ok = out[-1][0], np.zeros_like(keys), np.zeros(len(keys), dtype=bool)
        key[1:] = _gram(last[:-1], last[1:])
        ok[k:] = row[k:] == row[:-k]
        out.append((key, ok))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        buffer, offsets = K.text_buffer(batch.column("text"))
        for a, b in K.row_blocks(offsets):
            block, at = K.LOWER[buffer[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            starts, ends, rows = K.find_words(block, at, K.SPACE)
            yield batch.slice(a, b - a), K.hash_spans(block, starts, ends), rows


class _Grams:
    """Counts of (context, suffix) pairs with bounded memory, as packed rows by bucket of their key."""

    LIMIT = 1 << 20
    NAMES = ["kind", "bucket", "a", "b", "c"]

    def __init__(self, kind: int, buckets: int) -> None:
        self.kind, self.shift, self.buckets, self.parts, self.size = kind, _U(64 - buckets.bit_length() + 1), buckets, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append(_summed(_gram(a, b) if self.kind else a, a, b, np.ones(len(a), dtype=_I)))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * self.LIMIT:
            self.parts = [_summed(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    def drain(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.size or not (whole or self.size > self.LIMIT):
            return
        key, a, b, c = _summed(*map(np.concatenate, zip(*self.parts, strict=True)))
        self.parts, self.size = [], 0
        cut = np.searchsorted(key >> self.shift, np.arange(self.buckets + 1, dtype=_U))  # the sums are in order of the first bits
        at = np.flatnonzero(np.diff(cut))
        packed = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in at], pa.binary()) for x in (a, b, c)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), self.kind)), pa.array(at), *packed], self.NAMES)


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of the run that context `a` makes with its suffix `b` (its last words and the next one)."""
    return K.mix(a * _U(0x9E3779B97F4A7C15) + b)


def _order(key: np.ndarray) -> np.ndarray:
    """An order by all but the last bits of hashed keys, which give way to places so that plain sorting finds it."""
    bits = _U(max(1, len(key).bit_length()))
    return (np.sort(key >> bits << bits | np.arange(len(key), dtype=_U)) & ((_U(1) << bits) - _U(1))).astype(_I)


def _summed(key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, exact: bool = False) -> tuple[np.ndarray, ...]:
    """Equal keys brought together; unless `exact`, one in billions may be left in two parts."""
    order = np.argsort(key) if exact else _order(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=_I)
    at = order[first]
    return key[first], a[at], b[at], np.add.reduceat(c[order], first) if len(first) else c


def _buckets(spark) -> int:
    """Ranges of the keys' first bits, a power of two of them; they follow the session's shuffle partitions."""
    return 1 << max(6, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())


def _counted(train: DataFrame, depth: int, min_count: int, known: np.ndarray | None = None) -> DataFrame:
    """(kind, gram, ctx, suffix, c): runs of depth + 1 tokens that occur `min_count` times (kind 1), and at depth 1 all words (kind 0).

    A deeper run is only counted where its context and its suffix may be listed in the filter `known`.
    Tasks send their counts packed, by ranges of the key, so that equal runs meet whatever words they have.
    """
    spark = train.sparkSession
    buckets = _buckets(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = _Grams(0, buckets), _Grams(1, buckets)
        for batch, hashes, rows in _blocks(batches):
            keys, row, _ = _sequence(hashes, rows, batch.num_rows, _END)
            runs = _runs(keys, row, depth)
            low, at = runs[depth - 1][0], np.flatnonzero(runs[depth][1])
            if shared.value is not None:
                may = maybe(shared.value, low)
                at = at[may[at - 1] & may[at]]
            grams.add(low[at - 1], low[at])
            yield from grams.drain()
            if depth == 1:
                words.add(hashes, np.zeros_like(hashes))
                yield from words.drain()
        yield from words.drain(whole=True)
        yield from grams.drain(whole=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        bucket = None

        def done() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True))
                    key, a, b, c = _summed(_gram(a, b) if kind else a, a, b, c, exact=True)
                    keep = c >= min_count if kind else slice(None)
                    columns = [x[keep].view(_I) for x in (key, a, b, c)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *map(pa.array, columns)], ["kind", "gram", "ctx", "suffix", "c"])
                    parts.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                kind, own, *packed = (column[i].as_py() for column in batch.columns)
                if own != bucket:
                    yield from done()
                    bucket = own
                held[kind].append(tuple(np.frombuffer(x, dtype=t) for x, t in zip(packed, (_U, _U, _I), strict=True)))
        yield from done()

    packed = train.select("text").mapInArrow(run, "kind long, bucket long, a binary, b binary, c binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "kind int, gram long, ctx long, suffix long, c long")


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted, unsigned) and counts of a table that a share of the tokens bounds."""
    got = df.select("key", "c").toArrow()
    keys, counts = got.column("key").to_numpy().view(_U), got.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _grown(level: DataFrame, lower: DataFrame, cutoff: float, prior: float) -> DataFrame:
    """(gram, ctx, c, of, p, listed, rest, stays, lead): probabilities of the continuations, in the state of the longest suffix that stayed.

    One row of a context is its `lead`.
    """
    rows = level.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix").select("gram", "ctx", "c", "q")
    rows = rows.join(lower.select(F.col("gram").alias("ctx"), F.col("c").alias("of")), "ctx")
    rows = rows.withColumn("own", (F.col("c") + prior * F.col("q")) / (F.col("of") + prior))
    whole = Window.partitionBy("ctx")
    rows = rows.select(
        "*", F.sum("c").over(whole).alias("seen"), F.sum("q").over(whole).alias("expected"), F.sum("own").over(whole).alias("taken"),
        F.sum(F.col("c") * F.log(F.col("c") / F.col("of") / F.col("q"))).over(whole).alias("ratio"), F.min("gram").over(whole).alias("least"),
    )
    others, left = F.col("of") - F.col("seen"), F.greatest(1 - F.col("expected"), F.lit(1e-12))
    ratio = F.col("ratio") + F.when(others > 0, others * F.log(others / F.col("of") / left)).otherwise(0.0)
    rows = rows.withColumns({"stays": ratio >= cutoff, "rest": F.log10(F.greatest(1 - F.col("taken"), F.lit(1e-12)) / left)})
    p = F.when(F.col("stays"), F.col("own")).otherwise(F.col("q"))
    listed = F.log10(F.col("own") / F.col("q")) - F.col("rest")
    single = lambda x, name: x.cast("float").alias(name)
    return rows.select("gram", "ctx", "c", "of", single(p, "p"), single(listed, "listed"), single(F.col("rest"), "rest"), "stays", (F.col("gram") == F.col("least")).alias("lead"))


def fit(train: DataFrame, min_count: int = 2, cutoff: float = 12.0, prior: float = 4.0, depth: int = 2) -> tuple[DataFrame, int, int, Tree]:
    """(staged unigram table (key, c), N, V, tree) of the texts in column `text`."""
    spark = train.sparkSession
    first = staged(_counted(train, 1, min_count), "lm-runs", by="kind")
    words = first.where("kind = 0").select(F.col("gram").alias("key"), "c")
    n_texts = train.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, vocabulary = n_words + n_texts, distinct + (n_texts > 0)
    denominator = float(total + 0.5 * (vocabulary + 1))
    least = max(2.0, _FREQUENT * total)
    frequent = Frequent(*_collected(words.where(F.col("c") >= least)))
    root = np.log10((np.r_[n_texts, frequent.counts] + 0.5) / denominator)
    end = spark.range(1).select(F.lit(int(_END.view(_I))).alias("gram"), F.lit(n_texts).cast("long").alias("c"))
    lower = words.select(F.col("key").alias("gram"), "c").union(end).where(F.col("c") >= min_count).withColumn("p", (F.col("c") + 0.5) / denominator)
    levels: list[DataFrame] = []
    for k in range(1, depth + 1):
        runs = first.where("kind = 1") if k == 1 else staged(_counted(train, k, min_count, bloom(lower.select(F.col("gram").alias("h")))), "lm-runs")
        levels.append(staged(_grown(runs.select("gram", "ctx", "suffix", "c"), lower, cutoff, prior), "lm-level"))
        if k > 1:
            discard(runs)
        else:
            words, first = staged(words, "lm-words"), discard(first)
        lower = levels[-1].select("gram", "c", "p")
    zero, parts = F.lit(0.0).cast("float"), []
    for level in levels:
        kept = level.where("stays")
        parts += [kept.select(F.col("gram").alias("key"), F.col("c").alias("n"), "listed", zero.alias("rest")), kept.where("lead").select(F.col("ctx").alias("key"), F.col("of").alias("n"), zero.alias("listed"), "rest")]
    values = parts[0]
    for part in parts[1:]:
        values = values.union(part)
    values = staged(values, "lm-tree")
    often = values.where(F.col("n") >= least).groupBy("key").agg(F.max("n").alias("n"), F.sum((F.col("listed") + F.col("rest")).cast("double")).alias("v"))
    cache = Cache.of(often)
    joined = values.where(F.col("n") < least).select("key").union(cache.lacking(values.where(F.col("n") >= least).select("key")))
    return words, total, vocabulary, Tree(frequent, root, depth, values, Cache.made(frequent.keys, frequent.counts, root[1:]), cache, bloom(joined.select(F.col("key").alias("h"))), levels)


def _logs(tree: Tree, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token of a sequence, with a small tree: log10 in its state, and at the root (0 for words that are not frequent)."""
    root = np.where(ids >= 0, tree.root[np.maximum(ids, 0)], 0.0)
    keys = np.where(ids >= 0, np.r_[_END, tree.words.keys][np.maximum(ids, 0)], _NONE)
    out, (table, listed, rest) = root.copy(), tree.collected
    for k, (key, ok) in enumerate(_runs(keys, row, tree.depth)):
        at = find(table, key)
        at[~ok] = -1
        value = lambda x, at=at: np.where(at >= 0, x[np.maximum(at, 0)], 0.0) if len(x) else np.zeros(len(at))
        if k:
            out += value(listed)
        if k < tree.depth:
            out[1:] += np.where(row[1:] == row[:-1], value(rest)[:-1], 0.0)
    return out, root


_FIELDS = ["row", "doc_id", "n_tokens", "n_frequent", "base", "gain"]
_SENT = "bucket int, kind int, data binary, row long, doc_id long, n_tokens long, n_frequent long, base double, gain double"
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte so that what neighbours share is small."""
    return zstd.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), 1)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw, widths = np.frombuffer(zstd.decompress(data), dtype=np.uint8), [np.dtype(t).itemsize for t in types]
    n, out, at = len(raw) // sum(widths), [], 0
    for t, width in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(t))
        at += n * width
    return out


def _sent(bucket: np.ndarray, kind: int, data: list[bytes] | None = None, fields: list[pa.Array] | None = None) -> pa.RecordBatch:
    """Rows that go to the buckets: packed ones, or what is known of texts."""
    n = len(bucket)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    blobs = pa.array(data, pa.binary()) if data else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.full(n, kind, dtype=np.int32)), blobs, *(fields or [pa.nulls(n, t) for t in types])], _SENT_NAMES)


class _Sorted:
    """Rows of (key, ...) columns, packed by ranges of the key when there are enough of them."""

    LIMIT = 1 << 20

    def __init__(self, kind: int, buckets: int) -> None:
        self.kind, self.buckets, self.shift, self.parts, self.size = kind, buckets, _U(64 - buckets.bit_length() + 1), [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def drain(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size and (whole or self.size > self.LIMIT):
            columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            order = _order(columns[0])
            columns = [c[order] for c in columns]
            cut = np.searchsorted(columns[0] >> self.shift, np.arange(self.buckets + 1, dtype=_U))
            at = np.flatnonzero(np.diff(cut))
            yield _sent(at, self.kind, [_pack(*(c[cut[i] : cut[i + 1]] for c in columns)) for i in at])


def _model_rows(model: DataFrame, buckets: int) -> DataFrame:
    """The table (key, c, v), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sorted(0, buckets)
        for batch in batches:
            key, c, v = (batch.column(i).to_numpy() for i in range(3))
            out.add(key.view(_U), c.astype(_I), v.astype(np.float32))
            yield from out.drain()
        yield from out.drain(whole=True)

    return model.mapInArrow(run, _SENT)


def _scored_rows(docs: DataFrame, tree: Tree, unseen: float, buckets: int) -> DataFrame:
    """What is known of each text already and, packed, its words that are not frequent and its other runs that may be in the tree.

    A word that is not frequent is a context as often as it stands in the text, so one key asks for both.
    """
    end = float(tree.root[0])
    model = docs.sparkSession.sparkContext.broadcast((tree.word_cache, tree.depth, tree.cache, tree.filter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, depth, cache, known = model.value
        asked = _Sorted(1, buckets)
        for batch, hashes, rows in _blocks(batches):
            n, number = batch.num_rows, batch.column("row").to_numpy()
            here, value = words.get(hashes)
            tail = ~here
            per_row = np.bincount(rows, minlength=n)
            tokens = per_row + 1
            base = end + np.bincount(rows, weights=np.where(here, value, unseen), minlength=n)
            frequent = np.bincount(rows, weights=here, minlength=n) + 1
            keys, row, at = _sequence(hashes, rows, n, _END)
            runs = _runs(keys, row, depth)
            runs[0][1][at + tokens] = False  # nothing follows the end token behind a text
            place = at[rows] + 1 + np.arange(len(rows)) - (np.cumsum(per_row) - per_row)[rows]
            runs[0][1][place[tail]] = False
            gain, found = np.zeros(n), [(rows[tail], hashes[tail])]
            for key, ok in runs:
                own, key = row[ok], key[ok]
                here, value = cache.get(key)
                gain += np.bincount(own, weights=value, minlength=n)
                ask = np.flatnonzero(~here)
                ask = ask[maybe(known, key[ask])] if len(ask) else ask
                found.append((own[ask], key[ask]))
            r, k = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            group = 2 * r + (np.arange(len(r)) < len(found[0][0]))  # odd: a word
            order = _order(K.mix(k + group.astype(_U) * _U(0x9FB21C651E98DF25)))
            group, k = group[order], k[order]
            new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (k[1:] != k[:-1])]) if len(k) else np.zeros(0, dtype=_I)
            count = np.diff(np.r_[new, len(k)])
            asked.add(k[new], number[group[new] >> 1], (count << 1 | group[new] & 1).astype(np.uint32))
            yield _sent(K.mix(number.view(_U)) >> asked.shift, 2, fields=[batch.column("row"), batch.column("doc_id"), *map(pa.array, (tokens.astype(_I), frequent.astype(_I), base, gain))])
            yield from asked.drain()
        yield from asked.drain(whole=True)

    return docs.mapInArrow(run, _SENT)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of one bucket and kind of batches that are sorted by both."""
    for batch in batches:
        if batch.num_rows:
            bucket, kind = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            cut = np.r_[0, np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1, len(bucket)]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield int(bucket[a]), int(kind[a]), batch.slice(a, b - a)


def _looked_up(sent: DataFrame, buckets: int) -> DataFrame:
    """Sums for texts, packed by ranges of a hash of their number: each bucket's requests meet its part of the table, which comes first.

    What is known of texts goes through as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model, table, sums = None, [], None, _Sums(buckets)
        for bucket, kind, batch in _by_bucket(batches):
            if bucket != now:
                now, model, table = bucket, [], None
            if kind == 2:
                yield batch
                continue
            if kind == 0:
                model += [_unpack(x.as_py(), "u8", "i8", "f4") for x in batch.column("data")]
                continue
            table = table or _table(model)
            for x in batch.column("data"):
                key, row, count = _unpack(x.as_py(), "u8", "i8", "u4")
                keys, c, v = table
                at = find(keys, key)
                hit = np.flatnonzero(at >= 0)
                at, row, word, count = at[hit], row[hit], (count[hit] & 1).astype(bool), (count[hit] >> 1).astype(float)
                seen = word & (c[at] > 0)
                sums.add(row, np.where(seen, count, 0.0), np.where(seen, np.log10(2.0 * c[at] + 1) * count, 0.0), v[at] * count)
                yield from sums.drain()
        yield from sums.drain(whole=True)

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, _SENT)


class _Sums:
    """Sums of three numbers by text, packed when there are many."""

    LIMIT = 1 << 20

    def __init__(self, buckets: int) -> None:
        self.parts, self.size, self.out = [], 0, _Sorted(1, buckets)

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def together(self) -> tuple[np.ndarray, ...]:
        row, *values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        row, at = np.unique(row, return_inverse=True)
        return row, *(np.bincount(at, weights=x, minlength=len(row)) for x in values)

    def drain(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size and (whole or self.size > self.LIMIT):
            row, *values = self.together()
            self.parts, self.size = [], 0
            self.out.add(K.mix(row.view(_U)), row, *values)
            yield from self.out.drain(whole=True)


def _added(sent: DataFrame) -> DataFrame:
    """Texts with all that was found for them: they and their sums meet by ranges of a hash of their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, found, now = [], _Sums(1), None

        def done() -> Iterator[pa.RecordBatch]:
            if texts:
                rows = pa.Table.from_batches(texts)
                row = rows.column("row").to_numpy()
                more = [np.zeros(len(row)) for _ in range(3)]
                if found.parts:
                    keys, *values = found.together()
                    at = find(keys, row)
                    more = [np.where(at >= 0, x[np.maximum(at, 0)], 0.0) for x in values]
                own = [rows.column(c).to_numpy() for c in ("n_frequent", "base", "gain")]
                columns = [own[0] + more[0].astype(_I), own[1] + more[1], own[2] + more[2]]
                yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in ("doc_id", "n_tokens")), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base", "gain"])
            texts.clear()
            found.parts, found.size = [], 0

        for bucket, kind, batch in _by_bucket(batches):
            if bucket != now:
                yield from done()
                now = bucket
            if kind == 2:
                texts.append(batch.select(_FIELDS))
            else:
                for x in batch.column("data"):
                    found.add(*_unpack(x.as_py(), "u8", "i8", "f8", "f8", "f8")[1:])
        yield from done()

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, gain double")


def _table(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys with their counts and sums of values."""
    if not parts:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=_I), np.zeros(0)
    key, c, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, c, v = key[order], c[order], v[order].astype(float)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.maximum.reduceat(c, first), np.add.reduceat(v, first)


def score_documents(docs: DataFrame, min_count: int = 2, cutoff: float = 12.0, prior: float = 4.0, fold: int = 1, folds: int = 5, depth: int = 2) -> DataFrame:
    """Score every text with a tree learnt from the rows whose crc32(doc_id) mod `folds` is not `fold`.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each input row.
    A null text is empty (it has its end token alone); a null doc_id counts as the empty text for the fold;
    repeated rows are repeated; other columns are ignored.  An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _scored(docs, min_count, cutoff, prior, fold, folds, depth)


def _scored(docs: DataFrame, min_count: int, cutoff: float, prior: float, fold: int, folds: int, depth: int) -> DataFrame:
    """The rows of `score_documents`, staged: batches are small only while a table is written."""
    rows = documents_of(docs)
    held = crc_of(F.col("doc_id")) % folds == fold
    words, total, vocabulary, tree = fit(rows.where(~held).select("text"), min_count, cutoff, prior, depth)
    discard(*tree.levels)
    unseen = float(np.log10(0.5 / (total + 0.5 * (vocabulary + 1))))
    buckets = _buckets(docs.sparkSession)
    model = words.select("key", "c", F.lit(0.0).alias("v")).union(tree.values.select("key", F.lit(0).cast("long"), (F.col("listed") + F.col("rest")).cast("double")))
    sent = _scored_rows(rows.withColumn("row", F.monotonically_increasing_id()), tree, unseen, buckets)
    summed = _added(_looked_up(_model_rows(model, buckets).union(sent), buckets))
    scores = summed.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") - (0 if total else 1)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"),
    )
    return staged(scores, "lm-scores")
