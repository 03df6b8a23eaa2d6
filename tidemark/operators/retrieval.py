"""Lexical and vector retrieval, fusion and ranking measures over whole query sets.

Queries are a table, so many are answered by one plan: query terms meet postings in an equi-join, scores are
partial sums, and the best k of each query come from a window that Spark limits before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators.staging import new_path, remove, staged

K1, B = 1.5, 0.75
# Documents and sets of terms that are scored at once; the most documents of a term that pairs are made of.
BLOCK_DOCS, BLOCK_SETS, RARE = 8192, 512, 256
# Scores of vectors that a worker holds at a time.
SCORES = 1 << 18
# Weights of the ranking signals.
FUSION_WEIGHTS = {"dense": 1.0, "sparse": 1.0, "freshness": 0.3, "authority": 0.3, "entity": 0.4, "temporal": 0.6}


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len) of docs(doc_id, text)."""
    return _counted(_split(docs))


def _split(docs: DataFrame) -> DataFrame:
    """(doc_id, t, len): tokens of docs(doc_id, text)."""
    return docs.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))


def _counted(split: DataFrame) -> DataFrame:
    return split.select("doc_id", "len", F.explode("t").alias("term")).groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))


def _scored(found: DataFrame, asked: DataFrame, size: DataFrame) -> DataFrame:
    """BM25 of postings(term, doc_id, tf, len) for asked(query_id, term, qf), with one row of (n_docs, avg_len)."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9))))
    weighed = found.join(df, "term").crossJoin(F.broadcast(size))  # one row of totals
    return weighed.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for every pair that shares a term, queries(query_id, text); nine decimals, so that equal texts tie."""
    size = docs.select(F.size(tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))
    asked = _asked(queries)
    return _scored(postings(docs).join(asked.select("term").distinct(), "term", "left_semi"), asked, size)


def _blocks_scored(sets: DataFrame, found: DataFrame, n_docs: int, avg_len: float, k: int) -> DataFrame:
    """(_set, doc_id, score): the best k documents of each block for each of sets(_set, t, w), found(doc_id, t, tf, len); t is a term's hash.

    Blocks of sets meet blocks of documents, so memory is that of a block, and of all pairs the best k leave it.
    Terms are added in the same order for every document, so that equal texts tie.
    """
    n_sets = -(-sets.select("_set").distinct().count() // BLOCK_SETS) or 1
    n_parts = -(-n_docs // BLOCK_DOCS) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sets.select("_set", "t", "w", F.pmod("_set", F.lit(n_sets)).cast("int").alias("sb"), every(n_parts).alias("db"))
    right = found.select("doc_id", "t", "tf", "len", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int").alias("db"), every(n_sets).alias("sb"))
    kind = found.schema["doc_id"].dataType.simpleString()

    def job(q: pa.Table, d: pa.Table) -> pa.Table:
        docs = d.column("doc_id").combine_chunks().dictionary_encode()
        names = docs.dictionary.take(pc.sort_indices(docs.dictionary))
        parts = [pa.table([pa.array([], pa.int64()), names.slice(0, 0), pa.array([], pa.float64())], ["_set", "doc_id", "score"])]
        if not q.num_rows or not d.num_rows:
            return parts[0]
        place = np.empty(len(names), dtype=np.int64)
        place[pc.sort_indices(docs.dictionary).to_numpy()] = np.arange(len(names))
        doc, t = place[docs.indices.to_numpy()], d.column("t").to_numpy()
        tf, size = d.column("tf").to_numpy().astype(np.float64), d.column("len").to_numpy().astype(np.float64)
        ids, which = np.unique(q.column("_set").to_numpy(), return_inverse=True)
        by_term = np.argsort(q.column("t").to_numpy(), kind="stable")
        terms, first, often = np.unique(q.column("t").to_numpy()[by_term], return_index=True, return_counts=True)
        which, w = which[by_term], q.column("w").to_numpy()[by_term]
        at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
        row = np.flatnonzero(terms[at] == t)
        row = row[np.lexsort((t[row], doc[row]))]
        doc, at, tf, low = doc[row], at[row], tf[row], tf[row] + K1 * (1 - B + B * size[row] / max(avg_len, 1e-9))
        score = np.zeros((len(names), len(ids)))
        upto = np.r_[0, np.cumsum(often[at])]
        bounds = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]  # documents are not cut
        start = 0
        while start < len(doc):
            stop = bounds[max(np.searchsorted(upto[bounds], upto[start] + (1 << 20), side="right") - 1, np.searchsorted(bounds, start, side="right"))]
            n = often[at[start:stop]]
            pair = np.repeat(np.arange(start, stop), n)
            entry = np.arange(len(pair)) - np.repeat(upto[start:stop] - upto[start], n) + first[at[pair]]
            a, b = doc[start], doc[stop - 1] + 1
            cell = (doc[pair] - a) * len(ids) + which[entry]
            score[a:b] = np.bincount(cell, weights=w[entry] * tf[pair] * (K1 + 1) / low[pair], minlength=(b - a) * len(ids)).reshape(b - a, len(ids))
            start = stop
        for i in range(0, len(ids), 64):
            own = np.rint(score[:, i : i + 64].T * 1e9) / 1e9
            best = np.argsort(-own, axis=1, kind="stable")[:, :k]
            got = np.take_along_axis(own, best, axis=1).ravel()
            good = got > 0
            parts.append(pa.table([pa.array(np.repeat(ids[i : i + 64], best.shape[1])[good]), names.take(pa.array(best.ravel()[good])), pa.array(got[good])], ["_set", "doc_id", "score"]))
        return pa.concat_tables(parts)

    return left.groupBy("sb", "db").cogroup(right.groupBy("sb", "db")).applyInArrow(job, f"_set long, doc_id {kind}, score double")


def _best(found: DataFrame, asked: DataFrame, n_docs: int, avg_len: float, k: int) -> DataFrame:
    """The best k documents by BM25 of each query of asked(query_id, term, qf), from postings found(term, doc_id, tf, len) of their terms.

    Few queries are scored as they are.  Of many, those that share their frequent terms (more than `RARE` documents)
    share that work: a document without any of a query's rare terms can be among its best k only when it is among the best k of
    the frequent ones, since rare terms only add; documents with a rare term are scored in full.
    """
    found = found.select("term", F.xxhash64("term").alias("t"), "doc_id", "tf", "len")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = staged(asked.join(df, "term").select("query_id", "term", F.xxhash64("term").alias("t"), (F.col("qf") * idf).alias("w"), "df"), "asked-terms")
    many = asked.select("query_id").distinct().count() > BLOCK_SETS
    often = asked.where(F.col("df") > RARE) if many else asked
    sets = staged(often.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("terms")).withColumn("_set", F.xxhash64("terms")), "sets")
    own = sets.groupBy("_set").agg(F.first("terms").alias("terms")).select("_set", F.explode("terms").alias("x")).select("_set", "x.*")
    hits = found.join(often.select("term").distinct(), "term", "left_semi") if many else found
    top = top_k(_blocks_scored(own, hits.select("doc_id", "t", "tf", "len"), n_docs, avg_len, k), k, by="_set").drop("rank")
    scored = sets.select("query_id", "_set").join(top, "_set").select("query_id", "doc_id", "score")
    if many:
        pairs = asked.where(F.col("df") <= RARE).select("query_id", "term").join(found.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct()
        whole = pairs.join(asked.select("query_id", "term", "t", "w"), "query_id").join(found.drop("t"), ["doc_id", "term"])
        part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.lit(avg_len), F.lit(1e-9))))
        in_order = F.sort_array(F.collect_list(F.struct("t", part.alias("part"))))
        total = F.rint(F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x["part"]) * 1e9) / 1e9
        full = whole.groupBy("query_id", "doc_id").agg(total.alias("score")).where("score > 0")
        scored = scored.unionByName(full).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k(scored, k)


class TextIndex:
    """Postings on disk as a log of segments that are never changed, with deletes beside them.

    `add` writes one segment and deletes what earlier segments have of the same doc_ids, so adding a document again
    replaces it; `delete` only names doc_ids.  A delete holds for the segments before it.  The manifest lists
    the segments and the number and length of live documents, carried on by the differences of each step; a
    step counts when its manifest is written, and readers take the last one.  Segments of like size are merged
    (`compact`), which drops what is deleted.  Postings lie in parts by term, and a query reads its terms' parts alone.
    """

    FAN = 4
    _MANIFEST = "segment long, n_docs long, deletes array<long>, live_docs long, live_len long, parts int"

    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.version, self.segments, self.live_docs, self.live_len = 0, [], 0, 0
        self.deletes: list[int] = []
        while self._exists(f"manifest/v={self.version + 1:06d}/_SUCCESS"):
            self.version += 1
        if self.version:
            rows = spark.read.schema(self._MANIFEST).parquet(f"{self.path}/manifest/v={self.version:06d}").collect()
            self.parts, self.live_docs, self.live_len, self.deletes = rows[0].parts, rows[0].live_docs, rows[0].live_len, list(rows[0].deletes)
            self.segments = sorted((r.segment, r.n_docs) for r in rows if r.segment >= 0)

    def _exists(self, name: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _next(self) -> int:
        """The number of the next segment or set of deletes: one that no step, finished or not, has used."""
        n = self.version + 1
        while self._exists(f"lengths/s={n}") or self._exists(f"deletes/s={n}"):
            n += 1
        return n

    def _publish(self) -> None:
        self.version += 1
        oldest = min((s for s, _ in self.segments), default=0)
        self.deletes = [d for d in self.deletes if d > oldest]  # what they deleted is gone with earlier segments
        rows = [(s, n, self.deletes, self.live_docs, self.live_len, self.parts) for s, n in self.segments or [(-1, 0)]]
        self.spark.createDataFrame(rows, self._MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={self.version:06d}")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int").alias("part")

    def _read(self, kind: str, segments: list[int]) -> DataFrame:
        """Rows of some segments, with their number as `s`."""
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/s={s}" for s in segments])

    def _live(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        """Rows(doc_id, s, ...) of documents that no later step has deleted."""
        later = [d for d in self.deletes if d > min(segments)]
        if not later:
            return rows
        dead = self._read("deletes", later).groupBy("doc_id").agg(F.max("s").alias("_until"))
        return rows.join(dead, "doc_id", "left").where(F.col("_until").isNull() | (F.col("s") >= F.col("_until"))).drop("_until")

    def _forget(self, ids: DataFrame, n: int) -> None:
        """Write the live documents among the ids as deletes of step n, and take them off the totals."""
        if not self.segments:
            return
        held = [s for s, _ in self.segments]
        gone = self._live(self._read("lengths", held), held).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        gone.select("doc_id", "len").write.mode("overwrite").parquet(f"{self.path}/deletes/s={n}")
        count, length = self.spark.read.parquet(f"{self.path}/deletes/s={n}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        self.live_docs, self.live_len = self.live_docs - count, self.live_len - length
        if count:
            self.deletes.append(n)

    def _write(self, found: DataFrame, lengths: DataFrame, n: int) -> int:
        """Write a segment; its number of documents."""
        found.select("term", "doc_id", "tf", "len", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/s={n}")
        lengths.select("doc_id", "len").write.mode("overwrite").parquet(f"{self.path}/lengths/s={n}")
        return self.spark.read.parquet(f"{self.path}/lengths/s={n}").count()

    def add(self, docs: DataFrame) -> None:
        """Take in documents(doc_id, text); those that are there already are replaced.  A batch has each doc_id once."""
        n = self._next()
        self._forget(docs, n)
        split = staged(_split(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), "tokens")
        # rows of a part stay together from the count to the file
        each = split.select("doc_id", "len", F.explode("t").alias("term")).withColumn("part", self._part()).repartition("part")
        count = self._write(each.groupBy("part", "term", "doc_id", "len").agg(F.count("*").alias("tf")), split, n)
        remove(self.spark, split._staged_at)
        length = self.spark.read.parquet(f"{self.path}/lengths/s={n}").agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
        self.live_docs, self.live_len = self.live_docs + count, self.live_len + length
        self.segments.append((n, count))
        self._publish()
        while len(self.segments) >= self.FAN and sum(c for _, c in self.segments[-self.FAN + 1 :]) >= self.segments[-self.FAN][1]:
            self.compact(self.FAN)

    def delete(self, ids: DataFrame) -> None:
        """Take documents out by doc_id; ids that aren't there do nothing."""
        self._forget(ids, self._next())
        self._publish()

    def compact(self, last: int | None = None) -> None:
        """Merge the last segments (or all) into one without deleted documents."""
        some = self.segments[-(last or len(self.segments)) :]
        if not some:
            return
        held, n = [s for s, _ in some], self._next()
        count = self._write(self._live(self._read("postings", held), held).repartition("part"), self._live(self._read("lengths", held), held), n)
        self.segments = [*self.segments[: -len(some)], (n, count)]
        self._publish()

    def top(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """The best k documents of each query(query_id, text)."""
        asked = _asked(queries)
        if not self.segments:
            return asked.select("query_id", F.lit(None).cast("string").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        wanted = asked.select("term", self._part()).distinct()
        parts = [r.part for r in wanted.select("part").distinct().collect()]  # at most `parts` of them
        held = [s for s, _ in self.segments]
        found = self._read("postings", held).where(F.col("part").isin(parts)).join(wanted, ["part", "term"], "left_semi")
        return _best(self._live(found, held), asked, self.live_docs, self.live_len / max(1, self.live_docs), k)


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", key: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The best k documents of each query; texts are cut into tokens once."""
    split, asked = staged(_split(docs), "tokens"), _asked(queries)
    n_docs, avg_len = split.agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(0.0))).first()
    found = staged(_counted(split).join(asked.select("term").distinct(), "term", "left_semi"), "found")
    return _best(found, asked, n_docs, avg_len, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length (a zero vector stays)."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.greatest(length, F.lit(1e-12)))


def pooled(tokens: DataFrame, keep: Column | None = None) -> DataFrame:
    """Unit vector of the mean of each text's token vectors, tokens(doc_id, embedding); rows where `keep` is false (padding) take no part."""
    rows = tokens if keep is None else tokens.where(keep)
    each = rows.select("doc_id", F.posexplode("embedding").alias("d", "x")).groupBy("doc_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = each.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return whole.select("doc_id", unit(F.col("v")).alias("v"))


def hashed_vector(text: Column, size: int = 256) -> Column:
    """A unit vector of a text's words hashed into `size` places, counts damped: vectors without a model."""

    @F.pandas_udf("array<float>")
    def made(words: pd.Series) -> pd.Series:
        def one(hashes: np.ndarray | None) -> np.ndarray:
            h = np.asarray(hashes if hashes is not None else [], dtype=np.int64)
            v = np.sqrt(np.bincount(h % size, minlength=size).astype(np.float64))
            return (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32)

        return words.map(one)

    return made(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(1 << 40))))


def quantized(v: Column) -> Column:
    """int8 codes: 127 times the unit vector, halves to even."""
    return F.transform(unit(v), lambda x: F.bround(x * 127).cast("tinyint"))


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, largest first, ties to the smaller place; NaN comes last."""
    worth = np.where(np.isnan(scores), -np.inf, scores)
    n, size = worth.shape
    if k >= size:
        at = np.tile(np.arange(size), (n, 1))
    else:
        least = np.partition(worth, size - k, axis=1)[:, size - k, None]
        above, tied = worth > least, worth == least
        tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= k - np.count_nonzero(above, axis=1)[:, None]
        at = np.flatnonzero(above | tied).reshape(n, k) % size
    order = np.argsort(-np.take_along_axis(worth, at, axis=1), axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1)


def best_scored(n_asked: int, n_rows: int, k: int, scores: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best of n_rows for each query; `scores` gives those of a range of queries, of which SCORES are held at a time."""
    step, places, found = max(1, SCORES // n_rows), [], []
    for i in range(0, n_asked, step):
        some = scores(i, min(step, n_asked - i))
        places.append(best_places(some, k))
        found.append(np.take_along_axis(some, places[-1], axis=1).astype(np.float64))
    return np.concatenate(places), np.concatenate(found)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 20, code: bool = False, rows: int = 16384, asked: int = 4096) -> DataFrame:
    """Exact cosine top k (or over int8 codes) of queries(query_id, q) over vectors(vec_id, embedding).

    Blocks of at most about `rows` vectors meet blocks of `asked` queries in an equi-join of block numbers; a job is
    a matrix product, of which it holds `SCORES` numbers at a time, and gives k rows for each of its queries.
    """
    n_rows, n_asked = -(-vectors.count() // rows) or 1, -(-queries.count() // asked) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    single = {vectors.schema["embedding"].dataType.simpleString(), queries.schema["q"].dataType.simpleString()} == {"array<float>"}
    kind = "array<float>" if single else "array<double>"
    left = queries.select("query_id", F.col("q").cast(kind).alias("v"), block("query_id", n_asked).alias("qb"), every(n_rows).alias("vb"))
    right = vectors.select("vec_id", F.col("embedding").cast(kind).alias("v"), block("vec_id", n_rows).alias("vb"), every(n_asked).alias("qb"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def unit_rows(t: pa.Table) -> np.ndarray:
        x = t.column("v").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if not code:
            return x
        x = np.rint(x * 127)  # products of whole numbers are exact, so equal ones tie
        return x.astype(np.float32) if x.shape[1] * 127 * 127 < 1 << 24 else x  # as far as single precision holds them exactly

    def job(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return schema.empty_table()
        by_id = np.argsort(v.column("vec_id").to_numpy())
        x, ids = unit_rows(v)[by_id], v.column("vec_id").to_numpy()[by_id]
        best, score = best_scored(q.num_rows, v.num_rows, k, lambda i, n: unit_rows(q.slice(i, n)) @ x.T)
        score = score / (127 * 127) if code else score
        return pa.table([pa.array(c) for c in (np.repeat(q.column("query_id").to_numpy(), best.shape[1]), ids[best].ravel(), score.ravel())], schema=schema)

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(job, "query_id long, vec_id long, score double")
    return top_k(found, k, key="vec_id")


def ivf_top(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95) -> DataFrame:
    """Top k of queries(query_id, q) by an inverted file over vectors(vec_id, embedding), made for the purpose; see `VectorIndex`."""
    from tidemark.operators.vectorindex import VectorIndex

    index = VectorIndex(vectors.sparkSession, new_path(vectors.sparkSession, "vector-index"))
    index.build(vectors, recall=recall, k=k)
    return index.top(queries, k)


def rrf(rankings: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, rank from 1) tables with weights."""
    parts = [df.select("query_id", "doc_id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for df, w in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def union_candidates(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Full outer union of two hit lists, 0 for what is missing on a side."""
    a, b = dense.select("query_id", "doc_id", F.col("score").alias("dense")), sparse.select("query_id", "doc_id", F.col("score").alias("sparse"))
    return a.join(b, ["query_id", "doc_id"], "full").fillna(0.0, ["dense", "sparse"])


def weighted_fuse(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Min-max normalised signals within each query, weighted; `explain` has each signal's part."""
    weights = {k: w for k, w in (weights or FUSION_WEIGHTS).items() if k in candidates.columns}
    by, total = Window.partitionBy("query_id"), sum(map(abs, weights.values())) or 1.0

    def part(c: str) -> Column:
        low, high = F.min(c).over(by), F.max(c).over(by)
        return F.when(high - low < 1e-9, 0.0).otherwise((F.col(c) - low) / (high - low)) * weights[c] / total

    out = candidates.withColumns({f"_{c}": part(c) for c in weights})
    score = reduce(lambda a, b: a + b, [F.col(f"_{c}") for c in weights])
    explain = F.create_map(*[x for c in weights for x in (F.lit(c), F.col(f"_{c}"))])
    return out.withColumns({"score": score, "explain": explain}).drop(*[f"_{c}" for c in weights])


def best_of_subqueries(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several sub-queries of a question (query_id, sub_id, doc_id, score): the best score of each document."""
    return top_k(hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def ranked_documents(ranked: DataFrame, parts: DataFrame) -> DataFrame:
    """Ranked chunks (query_id, doc_id, rank) as ranked documents, parts(chunk_id, doc_id): each at the place of its best chunk, ranks from 1 without gaps."""
    best = ranked.select("query_id", F.col("doc_id").alias("chunk_id"), "rank").join(parts.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id", "doc_id").agg(F.min("rank").alias("_at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "doc_id"))).drop("_at")


def hard_negatives(ranked: DataFrame, gold: DataFrame, n: int = 4) -> DataFrame:
    """The best ranked documents that are not gold."""
    left = ranked.join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").drop("rank")
    return top_k(left, n)


def ranking_measures(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """recall, precision, mrr and ndcg at k of each query: ranked(query_id, doc_id, rank), gold(query_id, doc_id, relevance)."""
    judged = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left")
    gain = F.coalesce("relevance", F.lit(0.0)) / F.log2(F.col("rank") + 1)
    hit = F.col("relevance").isNotNull()
    per = judged.groupBy("query_id").agg(F.sum(hit.cast("int")).alias("hits"), F.count("*").alias("shown"), F.max(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.sum(gain).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = gold.withColumn("p", place).groupBy("query_id").agg(F.count("*").alias("n_gold"), F.sum(F.when(F.col("p") <= k, F.col("relevance") / F.log2(F.col("p") + 1)).otherwise(0.0)).alias("idcg"))
    both = ideal.join(per, "query_id", "full").fillna(0)
    return both.select(
        "query_id", F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("hits") / F.col("n_gold")).alias("recall"), F.when(F.col("shown") == 0, 0.0).otherwise(F.col("hits") / F.col("shown")).alias("precision"),
        F.col("mrr").cast("double").alias("mrr"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )
