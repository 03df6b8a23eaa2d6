"""MinHash near-duplicates by tensored banding.

A table's key is a pair of half-keys, one from each of two collections of `HALVES`; a half-key is made of `ROWS`
minima of the shingle set.  All pairs are tables, so `HALVES` squared tables of 2 `ROWS` minima each cost
2 `HALVES` `ROWS` minima, the square root of what tables of their own would.  Two sets of similarity s meet in
a table with probability (1 - (1 - s^4)^20)^2: all but 5 in 100,000 at 0.8, all but 1 in 10^9 at 0.9, 2 % at 0.3.

Equal shingle sets are one node from the start.  A half-key that no other node has can be in no shared table, so
only shared ones are paired; most nodes have none on one of the sides and send no key at all.  A table's members
are linked to the smallest of them, never in pairs, and what such candidate links connect is compared on full
shingle sets, tile by tile, behind a 128-bit sketch of the minima's bits (a pair of similarity 0.8 differs in 13
of them on average, with a standard deviation of 3.4; `RADIUS` is 8 of these above).  Only verified links count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.filters import bloom, maybe
from tidemark.llm.simhash import _tile_links, components
from tidemark.llm.skew import joined
from tidemark.llm.store import discard, documents_of, small_batches, staged

WIDTH, SIMILARITY = 4, 0.8
HALVES, ROWS = 20, 4
SKETCH, RADIUS = 128, 40
_MINIMA = 2 * HALVES * ROWS
_U = np.uint64
_MULTIPLY = K.mix(np.arange(1, _MINIMA + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_WEIGHTS = K.mix(np.arange(77, 77 + ROWS, dtype=_U)) | _U(1)
_NAMES = K.mix(np.arange(1000, 1000 + 2 * HALVES, dtype=_U))
_CHUNK = 1 << 15


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows (first, last) with their sets one after the other: sorted distinct 64-bit hashes, and each row's size."""
    buffer, offsets = K.text_buffer(column)
    for first, last in K.row_blocks(offsets):
        ends_at = offsets[first : last + 1] - offsets[first]
        text = K.LOWER[buffer[offsets[first] : offsets[last]]]
        starts, ends, row = K.find_words(text, ends_at, K.SPACE)
        words, n = K.hash_spans(text, starts, ends), np.bincount(row, minlength=last - first)
        grams, owner = K.gram_hashes(words, width), row[: max(0, len(words) - width + 1)]
        inside = owner == row[width - 1 :] if len(owner) else np.zeros(0, dtype=bool)
        grams, owner = [grams[inside]], [owner[inside]]
        for k in range(1, width):  # texts of fewer words: the whole sequence
            short = np.flatnonzero(n == k)
            if len(short):
                grams.append(K.gram_hashes(words, k)[np.searchsorted(row, short)])
                owner.append(short)
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        fresh = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, dtype=bool)
        yield first, last, grams[fresh], np.bincount(owner[fresh], minlength=last - first)


def minima(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(row, function): the least value of each row's set under each function; empty sets must be left out."""
    out = np.full((len(sizes), _MINIMA), ~_U(0))
    starts = np.cumsum(sizes) - sizes
    for i in range(0, len(grams), _CHUNK):  # sets may run over several chunks
        part = grams[i : i + _CHUNK]
        a = int(np.searchsorted(starts, i, side="right")) - 1
        b = int(np.searchsorted(starts, i + len(part), side="left"))
        cuts = np.maximum(starts[a:b] - i, 0)
        for j, m in enumerate(_MULTIPLY):
            out[a:b, j] = np.minimum(out[a:b, j], np.minimum.reduceat(part * m, cuts))
    return out


def half_keys(least: np.ndarray) -> np.ndarray:
    """(row, 2 HALVES): the first half of the columns is one collection, the second the other; no two columns share a key."""
    return K.mix((least.reshape(len(least), 2 * HALVES, ROWS) * _WEIGHTS).sum(axis=2, dtype=_U) ^ _NAMES)


def sketches(least: np.ndarray) -> np.ndarray:
    """(row, 2): one mixed bit of each of the first minima."""
    bits = (K.mix(least[:, :SKETCH].copy()) & _U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


_SIGNED = "doc_id long, text_key long, s0 long, s1 long, size long, f0 long, f1 long, halves array<long>"


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For every row its set's name (128 bits) and size, the sketch and the half-keys (null without words), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        for batch in batches:
            for first, last, grams, sizes in shingle_sets(batch.column("text"), width):
                ends, full = np.cumsum(sizes), np.flatnonzero(sizes)
                names = np.array([divmod(xxhash.xxh3_128_intdigest(grams[b - n : b].tobytes()), 1 << 64) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], dtype=_U).reshape(-1, 2)
                least = minima(grams, sizes[full])
                prints, halves = np.zeros((len(sizes), 2), dtype=_U), half_keys(least)
                prints[full] = sketches(least)
                at = np.r_[0, np.cumsum((sizes > 0) * 2 * HALVES)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), long(halves.ravel()))
                of = [batch.column(c).slice(first, last - first) for c in ("doc_id", "text_key")]
                columns = [*of, long(names[:, 0]), long(names[:, 1]), pa.array(sizes.astype(np.int64)), long(prints[:, 0]), long(prints[:, 1]), lists]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SIGNED.split(", ")])

    with small_batches(docs.sparkSession):
        return staged(_keyed(docs).mapInArrow(run, _SIGNED), "signatures")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = documents_of(docs)
    return rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b) links, staged: each node(rep, halves) of a table that several share with the smallest node there."""
    size = nodes.count()
    halves = nodes.select("rep", F.posexplode("halves").alias("i", "h")).select("rep", (F.col("i") < HALVES).alias("left"), "h")
    shared = staged(halves.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared-halves")
    met = joined(halves, shared, ["h"], 2 * HALVES * size, "inner")
    side = lambda c: F.collect_set(F.when(c, F.col("h")))
    sides = met.groupBy("rep").agg(side(F.col("left")).alias("x"), side(~F.col("left")).alias("y")).where((F.size("x") > 0) & (F.size("y") > 0))
    sides = staged(sides, "sides")
    discard(shared)
    tables = sides.select("rep", F.explode("x").alias("x"), "y").select("rep", "x", F.explode("y").alias("y")).select("rep", F.xxhash64("x", "y").alias("key"))
    total = sides.agg(F.coalesce(F.sum(F.size("x") * F.size("y")), F.lit(0))).first()[0]
    least = staged(tables.groupBy("key").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1"), "tables")
    links = joined(tables, least, ["key"], total, "inner").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    links = staged(links, "candidates")
    discard(sides, least)
    return links


def verified(docs: DataFrame, near: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) links, staged, between nodes near(rep, cell, s0, s1, f0, f1, size, text_key) of one cell whose full sets are similar enough."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(near.select(F.col("text_key").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the texts that are candidates' (a few others may be among them), each once in a task."""
        seen: set[int] = set()
        for batch in batches:
            keys, new = batch.column("text_key").to_numpy(), []
            for r in np.flatnonzero(maybe(wanted.value, keys.view(_U))).tolist():
                if int(keys[r]) not in seen:
                    seen.add(int(keys[r]))
                    new.append(r)
            for _, _, grams, sizes in shingle_sets(batch.column("text").take(pa.array(new, pa.int64())), width):
                sets = [grams[b - n : b].tobytes() for b, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True) if n]
                names = np.array([divmod(xxhash.xxh3_128_intdigest(s), 1 << 64) for s in sets], dtype=_U).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(sets, pa.binary())], ["s0", "s1", "grams"])

    sets = _keyed(docs).mapInArrow(run, "s0 long, s1 long, grams binary")
    with small_batches(docs.sparkSession):
        rows = staged(sets.join(near.drop("text_key"), ["s0", "s1"]).dropDuplicates(["rep"]).select("rep", "cell", "f0", "f1", "size", "grams"), "candidate-sets")
        links = _tile_links(rows, ["f0", "f1"], RADIUS, similarity)
    discard(rows)
    return links


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links of at least the Jaccard `similarity` reach), kept.

    Shingles are told apart by 64-bit hashes of their lower-cased words.  Nulls and texts without words have no
    shingles, are linked with nothing and are components of their own.  A null doc_id takes part and is a
    component_id only where no other id is reached (`kept` is true there); rows that repeat a doc_id are told apart
    by their text; repeated rows are repeated; other columns are ignored; an empty table gives no rows.
    """
    rows = signatures(docs, width)
    some = F.any_value
    nodes = rows.where("size > 0").groupBy("s0", "s1").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[some(c).alias(c) for c in ("text_key", "size", "f0", "f1", "halves")])
    nodes = staged(nodes.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    possible = candidates(nodes.select("rep", "halves"))
    found = components(possible).select(F.col("node").alias("rep"), F.col("label").alias("cell"))
    near = staged(nodes.join(found, "rep").select("rep", "cell", "s0", "s1", "f0", "f1", "size", "text_key"), "near")
    discard(possible)
    links = verified(docs, near, width, similarity)
    discard(near)
    label = components(links).select(F.col("node").alias("rep"), "label")
    named = staged(nodes.select("rep", "s0", "s1", "n", "least").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labels")
    discard(links)
    least = staged(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    named = joined(named.withColumnRenamed("n", "rows"), least, ["label"], named.count()).select("s0", "s1", F.col("rows").alias("n"), "component_id")
    named = staged(named, "named")
    linked = joined(rows.where("size > 0").select("doc_id", "s0", "s1", "size"), named, ["s0", "s1"], rows.count())
    alone = rows.where("size = 0").select("doc_id", "s0", "s1", "size", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows without those that another with a smaller doc_id stands for."""
    kept = near_duplicates(docs, width, similarity).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
