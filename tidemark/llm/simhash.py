"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy exclusive-or and bit counts, tile against tile, and a tile pair is
skipped when its population counts differ beyond the radius.  Which fingerprints meet is settled before that,
by cells:

* up to 2 bits, cells of equal population counts of eight 8-bit parts.  Two fingerprints at most 2 bits apart
  have count vectors at most 2 apart, so there is a vector within 1 of both; each fingerprint is sent to its
  own cell and to those 1 away, and no pair is missed.
* for wider radii, `BANDS` cells named by `BAND_ROWS` minima of the shingle set under as many hash functions.
  Two sets of similarity s share one with probability 1 - (1 - s^4)^16: 0.9998 at 0.8, 0.12 at 0.3.  A link is
  a candidate only: the shingle sets of what candidates connect are brought together, and a pair is linked when
  its Jaccard similarity is high enough.

A cell is dealt out in tiles of about `TILE_ROWS`.  First each tile is compared with itself and with `ANCHORS`
rows of its cell; a large group of near copies is one component after that, and only tiles that aren't then meet
in pairs.  So no task's memory follows a cell, and links that a tile pair may add are all looked for.

Equal fingerprints are one row from the start.  A tile gives each fingerprint at most one link (to the
smallest it is connected with in the tile), never all pairs of a group; components come from alternating
large-star and small-star rounds over staged tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textkernel as K
from tidemark.llm.filters import bloom, maybe
from tidemark.llm.skew import joined
from tidemark.llm.store import discard, documents_of, staged, unused

SEED = 42
TILE_ROWS = 4096
TILE_GRAMS = 1 << 22
ANCHORS = 32
BANDS, BAND_ROWS = 16, 4
MARGIN = 8
_STEP = 1024
_NO_ID = (1 << 63) - 1


def _spans(text: bytes, width: int) -> tuple[bytes, list[int], list[int]]:
    """A text's words joined by one space, and the starts and ends of its shingles there."""
    words = text.lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(width, len(words))
    return b" ".join(words), starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()


def _hashes(spans: tuple[bytes, list[int], list[int]], seed: int) -> np.ndarray:
    whole, starts, ends = spans
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=len(starts))


_MULTIPLY = K.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def minima_cells(hashes: np.ndarray) -> np.ndarray:
    """Names of the `BANDS` cells of a set of shingle hashes; an empty set has one cell for each band too."""
    least = np.full(len(_MULTIPLY), ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _MULTIPLY).min(axis=0))
    return K.gram_hashes(least, BAND_ROWS)[::BAND_ROWS] ^ K.mix(np.arange(BANDS, dtype=np.uint64))


def fingerprint(text: bytes, width: int, seeds: tuple[int, ...], as_set: bool = False) -> tuple[list[int], int, int, np.ndarray | None]:
    """SimHash words of one text (one for each seed), its number of distinct shingles, a hash of their set and, where `as_set`, its cells.

    Repeated shingles count once where `as_set`.
    """
    whole, starts, ends = _spans(text, width)
    if not starts:
        return [0] * len(seeds), 0, 0, minima_cells(np.zeros(0, dtype=np.uint64)) if as_set else None
    out, hashes = [], _hashes((whole, starts, ends), seeds[0])
    distinct, at = np.unique(hashes, return_index=True)
    if as_set and len(at) < len(starts):
        hashes, starts, ends = distinct, [starts[i] for i in at], [ends[i] for i in at]
    for k, seed in enumerate(seeds):
        hashes = _hashes((whole, starts, ends), seed) if k else hashes
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), 8192):
            counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]))
    return out, len(distinct), xxhash.xxh64_intdigest(distinct.tobytes()), minima_cells(distinct) if as_set else None


def fingerprints(docs: DataFrame, width: int = 3, n_words: int = 1, as_set: bool = False) -> DataFrame:
    """(doc_id, text_key, f0[, f1], size, shape[, cells]) for every row; a null or wordless text has fingerprint zero."""
    seeds = tuple(SEED + i for i in range(n_words))
    names = ["doc_id", "text_key", *[f"f{i}" for i in range(n_words)], "size", "shape"]
    types = ", ".join([*[f"{n} long" for n in names], *["cells array<long>"] * as_set])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64))
        for batch in batches:
            buffer, offsets = K.text_buffer(batch.column("text"))
            got = [fingerprint(buffer[a:b].tobytes(), width, seeds, as_set) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [*[long([g[0][i] for g in got]) for i in range(n_words)], long([g[1] for g in got]), long([g[2] for g in got])]
            if as_set:
                cells = np.concatenate([g[3] for g in got] or [np.zeros(0, dtype=np.uint64)]).view(np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(cells) + 1, BANDS, dtype=np.int32)), pa.array(cells)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], [*names, *["cells"] * as_set])

    return _keyed(docs).select("doc_id", "text_key", "text").mapInArrow(run, types)


def _keyed(docs: DataFrame) -> DataFrame:
    return documents_of(docs).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


class _Groups:
    """Roots of what has been linked so far."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            i, j = i[apart], j[apart]
            if not len(i):
                return
            np.minimum.at(self.root, high[apart], low[apart])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


class _Verified(_Groups):
    """Groups linked only by pairs whose shingle sets have at least a Jaccard similarity; what is linked already isn't compared again."""

    def __init__(self, grams: list[np.ndarray], similarity: float) -> None:
        super().__init__(len(grams))
        self.grams, self.similarity = grams, similarity

    def _similar(self, a: int, b: int) -> bool:
        x, y = self.grams[a], self.grams[b]
        if min(len(x), len(y)) + 1e-9 < self.similarity * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both + 1e-9 >= self.similarity * (len(x) + len(y) - both)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            one, others = i[a], j[a:b]
            while True:
                others = others[self.root[others] != self.root[one]]
                if not len(others):
                    break
                if self._similar(one, others[0]):
                    super().link(np.array([one]), others[:1])
                others = others[1:]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of every row of x against every row of y."""
    total = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    for w in range(1, x.shape[1]):
        total = total + np.bitwise_count(x[:, None, w] ^ y[None, :, w])
    return total


def _compare(left: np.ndarray, right: np.ndarray | None, radius: int, groups: _Groups, at: np.ndarray) -> None:
    """Link the rows of a tile, or of one tile with those of another, in steps ordered by population count."""
    both = [left, left if right is None else right]
    ones = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in both]
    order = [np.argsort(o, kind="stable") for o in ones]
    base = 0 if right is None else len(left)
    for i in range(0, len(left), _STEP):
        a = order[0][i : i + _STEP]
        low, high = ones[0][a[0]], ones[0][a[-1]]
        for j in range(i if right is None else 0, len(both[1]), _STEP):
            b = order[1][j : j + _STEP]
            if ones[1][b[0]] - high > radius:
                break
            roots = groups.root[np.r_[at[a], at[base + b]]]
            if low - ones[1][b[-1]] > radius or (roots == roots[0]).all():
                continue
            x, y = np.nonzero(_apart(both[0][a], both[1][b]) <= radius)
            groups.link(at[a[x]], at[base + b[y]])


def _linked(job: np.ndarray, fps: np.ndarray, reps: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int, groups: _Groups | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole jobs, rows ordered by job: each row with the smallest id it is connected with in its job."""
    n, groups = len(job), groups or _Groups(len(job))
    first = np.flatnonzero(np.r_[True, job[1:] != job[:-1]])
    size = np.diff(np.r_[first, n])
    small = np.repeat(size <= 64, size) & ~cross
    shift = 1
    while shift < n:
        near = np.flatnonzero((job[shift:] == job[:-shift]) & small[shift:])
        if not len(near):
            break
        apart = sum(np.bitwise_count(fps[near, w] ^ fps[near + shift, w]).astype(np.int64) for w in range(fps.shape[1]))
        near = near[apart <= radius]
        groups.link(near, near + shift)
        shift += 1
    for k in np.flatnonzero((size > 64) | cross[first]):
        at = np.arange(first[k], first[k] + size[k])
        if cross[first[k]]:
            at = np.r_[at[side[at] == 0], at[side[at] == 1]]
            cut = int((side[at] == 0).sum())
            _compare(fps[at[:cut]], fps[at[cut:]], radius, groups, at)
        else:
            _compare(fps[at], None, radius, groups, at)
    best = np.full(n, _NO_ID)
    np.minimum.at(best, groups.root, reps)
    best = best[groups.root]
    keep = best != reps
    return reps[keep], best[keep]


def _tile_links(rows: DataFrame, words: list[str], radius: int, similarity: float | None = None) -> DataFrame:
    """(a, b) links, staged, between representatives of fingerprints in the same cell at most `radius` bits apart.

    With a `similarity` the rows have `grams` (and `size`, their number), and a link takes that similarity too.
    """
    checked = ["grams"] if similarity else []
    n_tiles = F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_GRAMS) if similarity else F.count("*") / TILE_ROWS
    large = staged(rows.groupBy("cell").agg(F.greatest(F.ceil(n_tiles), F.lit(1)).cast("int").alias("tiles")).where("tiles > 1"), "large-cells")
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    columns = ["cell", *words, "rep", *checked]

    def jobs(each: DataFrame, low: Column | str, high: Column | str, side: Column) -> DataFrame:
        low, high = (F.col(x) if isinstance(x, str) else x for x in (low, high))
        return each.select(F.xxhash64("cell", low, high).alias("job"), *words, "rep", side.cast("int").alias("side"), (low != high).alias("crossed"), *checked)

    own = rows.join(large, "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", mine)
    once = jobs(own, "tile", "tile", F.lit(0))
    if large.isEmpty():
        return staged(_job_links(once, words, radius, similarity), "links")
    split = rows.join(large, "cell").withColumn("tile", mine)
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("rep"), "rep"))
    anchors = split.withColumn("nth", nth).where(F.col("nth") <= ANCHORS).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("other <> tile")
    inside = staged(_job_links(once.union(jobs(anchors, "other", "other", F.lit(0))), words, radius, similarity), "links")
    known = split.select("cell", "tile", "rep").join(components(inside).withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    tiles = known.groupBy("cell", "tile").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    one = F.when(F.col("label") == F.col("most"), F.col("label"))  # null: the tile isn't one component yet
    open_cells = tiles.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("tile", one.alias("label")))).alias("labels"), F.min("label").alias("least"), F.max("most").alias("most"))
    open_cells = staged(open_cells.where("least < most").select("cell", "labels"), "open-cells")
    pairs = split.join(open_cells, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("other <> tile")
    pairs = pairs.where(F.coalesce(F.element_at("labels", F.col("tile")) != F.element_at("labels", F.col("other")), F.lit(True))).select(*columns, "tile", "other")
    across = _job_links(jobs(pairs, F.least("tile", "other"), F.greatest("tile", "other"), F.col("tile") > F.col("other")), words, radius, similarity)
    out = staged(inside.union(across), "links")
    discard(inside, large, open_cells)
    return out


def _job_links(jobs: DataFrame, words: list[str], radius: int, similarity: float | None) -> DataFrame:
    """(a, b) links that the jobs find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(ready: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(ready)
            column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            fps = np.stack([column(w).view(np.uint64) for w in words], axis=1)
            groups = _Verified([np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()], similarity) if similarity else None
            a, b = _linked(column("job"), fps, column("rep"), column("side"), column("crossed"), radius, groups)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            job = batch.column("job").to_numpy()
            if held and job[0] == job[-1] == held[-1].column("job")[-1].as_py():
                held.append(batch)
                continue
            cut = int(np.searchsorted(job, job[-1], side="left"))
            ready = [x for x in (*held, batch.slice(0, cut)) if x.num_rows]
            if ready:
                yield links(ready)
            held = [batch.slice(cut)]
        if held:
            yield links(held)

    return jobs.repartition("job").sortWithinPartitions("job").mapInArrow(run, "a long, b long")


def _cells(radius: int) -> Column:
    """The cells in which a fingerprint is compared."""
    if radius > 2:
        return F.col("cells")
    ones = [F.bit_count(F.col("f0").bitwiseAND(F.lit((255 << 8 * j) - (1 << 64 if j == 7 else 0)))).cast("long") for j in range(8)]
    own = sum((c * (1 << 4 * j) for j, c in enumerate(ones)), F.lit(0).cast("long"))
    lower = [F.when(c > 0, own - (1 << 4 * j)) for j, c in enumerate(ones)]
    return F.filter(F.array(own, *[own + (1 << 4 * j) for j in range(8)], *lower), lambda c: c.isNotNull())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of an edge list (a, b) is connected with."""

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = staged(ordered(edges), "edges")
    count = edges.count()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n")), "stars")
        large = ordered(joined(both.where("b > a"), low, ["a"], count, "inner").select(F.col("b").alias("a"), F.col("low").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        last, before, edges = edges, count, staged(ordered(small), "edges")
        count = edges.count()
        same = count == before and edges.join(last, ["a", "b"], "left_anti").isEmpty()
        discard(last, low)
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.distinct())


def _verified(docs: DataFrame, unique: DataFrame, found: DataFrame, words: list[str], width: int, radius: int, similarity: float) -> DataFrame:
    """(a, b) links inside candidate components between nodes whose shingle sets are similar enough."""
    near = unique.join(found.withColumnRenamed("node", "rep"), "rep").select("rep", F.col("label").alias("cell"), *words, "size", "text_key")
    near = staged(near, "candidates")
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(near.select(F.col("text_key").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets of the texts that are candidates' (a few others may be among them), each once in a task."""
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("text_key").to_numpy()
            new = []
            for r in np.flatnonzero(maybe(wanted.value, keys.view(np.uint64))).tolist():
                if int(keys[r]) not in seen:
                    seen.add(int(keys[r]))
                    new.append(r)
            texts = batch.column("text").take(pa.array(new, pa.int64())).to_pylist()
            grams = [np.unique(_hashes(_spans((t or "").encode(), width), SEED)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(grams, pa.binary())], ["text_key", "grams"])

    sets = _keyed(docs).select("text_key", "text").mapInArrow(run, "text_key long, grams binary")
    rows = staged(sets.join(near, "text_key").dropDuplicates(["rep"]).select("rep", "cell", *words, "size", "grams"), "candidate-sets")
    links = _tile_links(rows, words, radius, similarity)
    discard(near, rows)
    return links


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, n_words: int = 1, similarity: float = 0.8) -> DataFrame:
    """Fingerprints of all rows and the components that links of at most `radius` differing bits form.

    Over 2 bits, repeated shingles count once, candidates are sought `MARGIN` bits further among texts that share a
    band of minima, and those whose shingle sets have at least the Jaccard `similarity` are linked, no others.

    Returns doc_id, text_key, fingerprint (16 hexadecimal digits for each 64-bit word), component_id (the
    smallest doc_id that can be reached).  Nulls and texts without words have fingerprint zero and are linked
    like any others; a null doc_id takes part and is a component_id only where no other id is reached; repeated
    rows are repeated; other columns are ignored; an empty table gives no rows.
    """
    return _labelled(docs, width, radius, n_words, similarity).select("doc_id", "text_key", "fingerprint", "component_id")


def _labelled(docs: DataFrame, width: int, radius: int, n_words: int, similarity: float) -> DataFrame:
    """The rows of `near_duplicates` and the component's label: nodes are fingerprints (or shingle sets), whatever ids they occur with."""
    words, wide = [f"f{i}" for i in range(n_words)], radius > 2
    radius += MARGIN * wide
    node = [*words, "size", "shape"] if wide else words
    prints = staged(fingerprints(docs, width, n_words, wide), "fingerprints")
    kept = [F.any_value("cells").alias("cells")] if wide else []
    unique = prints.groupBy(*node).agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), *kept)
    unique = staged(unique.withColumn("rep", F.monotonically_increasing_id()), "unique-fingerprints")
    rows = unique.select(*words, "rep", F.explode(_cells(radius)).alias("cell"))
    links = _tile_links(rows, words, radius)
    found = components(links)
    if wide:
        links = _verified(docs, unique, found, words, width, radius, similarity)
        found = components(links)
    discard(links)
    named = unique.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select(*node, "label", "component_id")
    shown = F.concat(*[F.lower(F.lpad(F.hex(w), 16, "0")) for w in words])
    return prints.join(named, node).select("doc_id", "text_key", shown.alias("fingerprint"), "component_id", "label")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 24, n_words: int = 2, similarity: float = 0.8) -> DataFrame:
    """The input rows, one of each near-duplicate component: that with the smallest doc_id.

    The radius (and `MARGIN`) only finds candidates: at a Jaccard similarity of 0.8, fingerprints of 128 bits over five-word
    shingles are 19 bits apart on average (4 bits standard deviation), unrelated texts 64.  A component without
    any doc_id keeps one row too; of rows with equal doc_id and text one stays.
    """
    ident, key = unused("ident", docs), unused("text_key", docs)
    given = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias(ident)
    labelled = _labelled(docs, width, radius, n_words, similarity)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias(ident), F.col("text_key").alias(key)))
    kept = labelled.groupBy("label").agg(first.alias("first")).select("first.*")
    keyed = docs.select(*[docs[c] for c in docs.columns], given, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias(key))
    return keyed.join(kept, [ident, key], "left_semi").dropDuplicates([ident, key]).select(docs.columns)
