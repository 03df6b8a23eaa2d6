"""Maximum inner product search over anisotropic four-bit codes, with exact reranking.

Vectors are cut into parts of two dimensions, each coded by one of 16 centroids.  Codes and codebooks
minimise |r|^2 + (eta - 1) (r . x/|x|)^2 for the residual r of a vector x: what errs along the vector counts
eta times, as it is what shifts large inner products.  Searching scans tables (a query's products with two
parts' centroids, summed, are looked up by one byte) and reranks the best `rerank` of each block by the exact
product in double precision.

The codebooks are fitted on a bounded sample (`sample` vectors, in order of a hash of the vector); every
vector is indexed.  Queries meet candidates block by block: a job holds at most about `CANDIDATES` by
`QUERIES` distinct vectors, and gives `k` + 1 rows for each of its queries.  Equal vectors are scanned once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import staged

CANDIDATES, QUERIES = 8192, 4096
_PART = 2


@dataclass
class Codebooks:
    """centroids[part, code] and the weight of the parallel error."""

    centroids: np.ndarray
    eta: float

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent, one part after the other, on the anisotropic loss."""
        parts = _parts(x)
        unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        codes = np.empty(parts.shape[:2], dtype=np.uint8)
        for s in range(parts.shape[1]):
            codes[:, s] = ((parts[:, s, None, :] - self.centroids[s]) ** 2).sum(axis=2).argmin(axis=1)
        parallel = ((parts - self.decoded(codes)) * unit).sum(axis=(1, 2))
        for _ in range(sweeps):
            for s in range(parts.shape[1]):
                error = parts[:, s, None, :] - self.centroids[s]
                along = (error * unit[:, s, None, :]).sum(axis=2)
                own = np.take_along_axis(along, codes[:, s, None].astype(np.intp), axis=1)[:, 0]
                loss = (error**2).sum(axis=2) + (self.eta - 1) * ((parallel - own)[:, None] + along) ** 2
                codes[:, s] = loss.argmin(axis=1)
                parallel += np.take_along_axis(along, codes[:, s, None].astype(np.intp), axis=1)[:, 0] - own
        return codes

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[np.arange(codes.shape[1]), codes]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, pair of parts, byte): products with the centroids of two parts, summed."""
        single = np.einsum("qsd,scd->qsc", _parts(queries), self.centroids).astype(np.float32)
        even, odd = single[:, 0::2], single[:, 1::2]
        return (odd[:, :, :, None] + even[:, :, None, :]).reshape(len(queries), even.shape[1], 256)


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows as (row, part, 2), filled with zeros to a whole number of pairs of parts."""
    room = -x.shape[1] % (2 * _PART)
    x = np.pad(x.astype(np.float64), ((0, 0), (0, room))) if room else x.astype(np.float64)
    return x.reshape(len(x), -1, _PART)


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 4) -> Codebooks:
    """Codebooks of a sample: 16 means for each part, then rounds of coding and of weighted least squares."""
    parts = _parts(x)
    n, n_parts, d = parts.shape
    eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(0)
    books = Codebooks(np.stack([parts[rng.choice(n, 16, replace=n < 16), s] for s in range(n_parts)]), 1.0)
    unit = parts / np.maximum(np.sqrt((parts**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
    for step in range(6 + rounds):
        books.eta = 1.0 if step < 6 else eta
        codes = books.encode(x, sweeps=0 if step < 6 else 1)
        parallel = ((parts - books.decoded(codes)) * unit).sum(axis=(1, 2))
        for s in range(n_parts):
            u, v, c = unit[:, s], parts[:, s], codes[:, s]
            others = parallel - ((v - books.centroids[s][c]) * u).sum(axis=1)
            weight = books.eta - 1
            a, b = np.zeros((16, d, d)), np.zeros((16, d))
            np.add.at(a, c, np.eye(d) + weight * u[:, :, None] * u[:, None, :])
            np.add.at(b, c, v + weight * u * (others + (u * v).sum(axis=1))[:, None])
            full = np.bincount(c, minlength=16) > 0
            books.centroids[s][full] = np.linalg.solve(a[full], b[full][:, :, None])[:, :, 0]
            parallel = others + ((v - books.centroids[s][c]) * u).sum(axis=1)
    return books


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(books: Codebooks, codes: np.ndarray, x: np.ndarray, queries: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: rows of the `keep` best by table scan, and their exact products."""
    packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
    exact, out = x.astype(np.float64), []
    for i in range(0, len(queries), 64):
        tables = books.tables(queries[i : i + 64])
        total = np.zeros((len(tables), len(x)), dtype=np.float32)
        for p in range(packed.shape[1]):
            total += tables[:, p].take(packed[:, p], axis=1)
        best = np.argpartition(-total, keep - 1, axis=1)[:, :keep] if keep < len(x) else np.tile(np.arange(len(x)), (len(tables), 1))
        for q, rows in zip(queries[i : i + 64].astype(np.float64), best, strict=True):
            out.append((rows, (exact[rows] * q).sum(axis=1)))
    return out


def _usable(rows: DataFrame, dim: int | None) -> Column:
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)) & (F.lit(True) if dim is None else F.size(v) == dim)


def search(embeddings: DataFrame, every: int = 20, k: int = 20, rerank: int = 100, sample: int = 16384) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
    part, nor do rows without vec_id; rows with equal vec_id and vector are one; a query's own vec_id is no
    candidate.  Ties go to the smaller vec_id.  Other columns are ignored; an empty table gives no rows.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"  # the measure is that of the original vectors
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    lengths = rows.where(_usable(rows, None)).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 1
    rows = rows.where(_usable(rows, dim)).withColumn("vkey", F.xxhash64("v"))
    wanted = k + 1
    order = Window.partitionBy("vkey", "v").orderBy("vec_id")
    ranked = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= wanted)
    vectors = staged(ranked.groupBy("vkey", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vkey", "v").distinct()
    queries = staged(asked.groupBy("vkey", "v").agg(F.count("*").alias("n")), "query-vectors")

    got = vectors.orderBy(F.xxhash64("vkey")).limit(sample).select("v").toArrow()
    fitted = _matrix(got.column("v"), dim) if got.num_rows else np.ones((1, dim))
    books = fit(fitted)
    n_vectors, n_queries = vectors.count(), queries.count()
    n_blocks, n_query_blocks = -(-n_vectors // CANDIDATES) or 1, -(-n_queries // QUERIES) or 1

    def encoded(batches):
        for batch in batches:
            if batch.num_rows:
                codes = books.encode(_matrix(batch.column("v"), dim))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vkey", "v", "ids")), pa.array([c.tobytes() for c in codes], pa.binary())], ["vkey", "v", "ids", "code"])

    index = staged(vectors.mapInArrow(encoded, f"vkey long, v {kind}, ids array<long>, code binary"), "index")
    block = F.pmod(F.xxhash64("vkey", F.lit(1)), F.lit(n_blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vkey", F.lit(2)), F.lit(n_query_blocks)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vkey", "v", query_block.alias("qb"), all_of(n_blocks).alias("cb"))
    right = index.select("v", "ids", "code", block.alias("cb"), all_of(n_query_blocks).alias("qb"))
    schema = pa.schema([("vkey", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def job(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        codes = np.frombuffer(b"".join(c.column("code").to_pylist()), dtype=np.uint8).reshape(c.num_rows, -1)
        ids, keys = c.column("ids").to_pylist(), q.column("vkey").to_numpy()
        found = _search(books, codes, _matrix(c.column("v"), dim), _matrix(q.column("v"), dim), min(rerank, c.num_rows))
        out_key, out_id, out_score = [], [], []
        for key, (at, score) in zip(keys, found, strict=True):
            best = sorted((-s, i) for s, r in zip(score, at, strict=True) for i in ids[r])[:wanted]
            out_key += [key] * len(best)
            out_id += [i for _, i in best]
            out_score += [-s for s, _ in best]
        return pa.table([pa.array(out_key, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_score, pa.float64())], schema=schema)

    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(job, "vkey long, vec_id long, score double")
    by_key = Window.partitionBy("vkey").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("r", F.row_number().over(by_key)).where(F.col("r") <= wanted).select("vkey", "vec_id", "score")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "vkey").join(near, "vkey").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
