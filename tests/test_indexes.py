"""Indexes on disk, with replacement, deletes, appends and merges, and interval joins, against plain computations."""

import random
import tracemalloc
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B
from tidemark.operators import claims as C
from tidemark.operators import intervals as I
from tidemark.operators import retrieval as R
from tidemark.operators import vectorindex as VI
from tidemark.operators.vectorindex import VectorIndex
from tidemark.plans.queries import QUERIES

DAY0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
DOCS = "doc_id long, text string"


# ---- text index


def prose(rng):
    return " ".join(rng.choice("red blue fox dog runs sits tall oak river stone".split()) for _ in range(rng.randint(1, 12)))


def same(index, live, spark, asked):
    rows = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 8), r["rank"]) for r in df.collect())
    docs = spark.createDataFrame(sorted(live.items()), DOCS)
    assert rows(index.top(asked, 5)) == rows(R.bm25_top(docs, asked, 5))


def test_replaced_and_deleted_documents_leave_a_rebuilt_index(spark, tmp_path):
    rng, live = random.Random(5), {}
    asked = spark.createDataFrame([(1, "red fox"), (2, "river stone oak"), (3, "dog dog runs"), (4, "zebra")], "query_id long, text string")
    index = R.TextIndex(spark, str(tmp_path / "i"), parts=8)
    assert index.top(asked).collect() == []
    for step in range(6):
        batch = {i: prose(rng) for i in rng.sample(range(30), 8)}
        index.add(spark.createDataFrame(sorted(batch.items()), DOCS))
        live |= batch
        if step % 2:
            gone = [*rng.sample(sorted(live), 3), 999]
            index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in gone}
        index = R.TextIndex(spark, str(tmp_path / "i"))  # a later session goes on
        assert (index.parts, index.live_docs) == (8, len(live))
        same(index, live, spark, asked)
    assert len(index.segments) < 6  # some were merged on the way
    index.compact()
    assert len(index.segments) == 1 and index.deletes == [] and index.segments[0][1] == len(live)
    same(index, live, spark, asked)


def test_a_step_that_did_not_end_counts_for_nothing(spark, tmp_path):
    index = R.TextIndex(spark, str(tmp_path / "i"), parts=4)
    index.add(spark.createDataFrame([(1, "red fox"), (2, "blue dog")], DOCS))
    broken = R.TextIndex(spark, str(tmp_path / "i"))
    broken._publish = lambda: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        broken.add(spark.createDataFrame([(2, "green cat")], DOCS))
    index = R.TextIndex(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "dog cat")], "query_id long, text string")
    assert [r.doc_id for r in index.top(asked).collect()] == [2] and index.live_docs == 2
    index.add(spark.createDataFrame([(3, "green cat")], DOCS))
    same(R.TextIndex(spark, str(tmp_path / "i")), {1: "red fox", 2: "blue dog", 3: "green cat"}, spark, asked)


def test_a_query_reads_the_parts_of_its_terms(spark, tmp_path):
    index = R.TextIndex(spark, str(tmp_path / "i"), parts=16)
    index.add(spark.createDataFrame([(i, f"word{i} other{i}") for i in range(60)], DOCS))
    plan = index.top(spark.createDataFrame([(1, "word7")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters: [")[1][:80]


# ---- vector index


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


def asked_of(df):
    return df.where("vec_id % 15 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def recall(index, df, k=10):
    pairs = lambda rows: {(r.query_id, r.vec_id) for r in rows.collect()}
    exact, found = pairs(R.vector_top(df, asked_of(df), k)), pairs(index.top(asked_of(df), k))
    assert len(found) == len(exact)
    return len(exact & found) / len(exact)


def test_vectors_are_found_after_appends_and_splits(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 24))
    x = centres[rng.integers(0, 8, 600)] + 0.4 * rng.normal(size=(600, 24))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(vectors(spark, x), recall=0.95, k=10, queries=100)
    assert 10 <= index.cells.num_rows <= 40 and 1 <= index.probes < index.cells.num_rows
    assert recall(index, vectors(spark, x)) >= 0.9
    more = centres[0] + 0.3 * rng.normal(size=(500, 24))  # all of them come to a few cells
    before = index.cells.num_rows
    index.append(vectors(spark, more, 600))
    assert index.cells.num_rows > before and len(index.segments) == 3
    index = VectorIndex(spark, str(tmp_path / "v"))
    both = vectors(spark, np.r_[x, more])
    n = np.array(index.cells.column("n").to_pylist())
    assert n.sum() == 1100 and recall(index, both) >= 0.9
    zero = vectors(spark, np.zeros((1, 24)), 5000)
    assert index.top(asked_of(zero), 3).count() == 0 and index.top(zero.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3).count() == 3
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "w")).build(both.limit(0))


def test_probes_of_a_cell_of_many_copies_are_bounded_in_a_worker(spark, tmp_path, monkeypatch):
    """All vectors are one, so the only cell has as many blocks as its rows ask for, and all queries meet each of them."""
    df = vectors(spark, np.ones((600, 4)))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(df, cells=1)
    ran = []
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: ran.append(f) or real(self, f, *a, **b))
    monkeypatch.setattr(VI, "JOB_ROWS", 4)
    found = index.top(asked_of(df), 3)
    said = pa.Table.from_batches(ran[0](iter(asked_of(df).toArrow().to_batches())))
    assert said.num_rows == asked_of(df).count()  # before: 150 times as many, with a query's vector in each
    want = {(r.query_id, rank, rank - 1) for r in asked_of(df).collect() for rank in (1, 2, 3)}
    assert {(r.query_id, r["rank"], r.vec_id) for r in found.collect()} == want


def test_equal_vectors_tie_wherever_they_stand(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(3000, 64))
    x[::3] = x[0]
    df = vectors(spark, x)
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(df, cells=4)
    asked = df.where("vec_id % 3 = 0 and vec_id < 201").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in index.top(asked, 10).collect())
    assert got == [(q, i + 1, 3 * i) for q in range(0, 201, 3) for i in range(10)]


def test_the_registered_search_has_its_recall(spark):
    sf = "/root/testdata/sf0.01"
    found, exact = ({(r.query_id, r.vec_id) for r in QUERIES[q](spark, sf).collect()} for q in ("vec_ivf", "vec_topk"))
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact)


# ---- intervals


def spans(rng, n, keys="ab"):
    out = []
    for i in range(n):
        start = rng.choice([None, *range(60)]) if rng.random() < 0.3 else rng.randrange(60)
        end = None if rng.random() < 0.1 else (start or 0) + rng.choice([0, 1, 2, 5, 30])
        out.append((rng.choice(keys), i, None if start is None else DAY0 + timedelta(days=start), None if end is None else DAY0 + timedelta(days=end)))
    return out


@pytest.mark.parametrize("width", [1, 3, 64])
def test_overlapping_pairs_once_each(spark, width):
    rows = spans(random.Random(width), 90) + [(None, 900, None, None), (None, 901, None, None)]
    df = spark.createDataFrame(rows, "k string, seq long, valid_from timestamp, valid_to timestamp").repartition(3)
    got = [tuple(sorted((r.seq_a, r.seq_b))) for r in I.overlapping(df, ("k",), width=width).collect()]
    before = lambda a, b: a is None or b is None or a < b
    want = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] is not None and a[0] == b[0] and before(a[2], b[3]) and before(b[2], a[3])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_a_long_history_costs_rows_and_pairs(spark):
    """100,000 versions of one key, each overlapping the next: copies and comparisons stay in proportion."""
    n = 100_000
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 10).alias("valid_from"), F.timestamp_seconds(F.col("id") * 10 + 15).alias("valid_to"))
    ranked = I.ranked(rows, ("k",), "valid_from", "valid_to", "seq")
    copies = ranked.select(F.sum(F.greatest(F.lit(0), F.floor((F.col("_reach") - 1) / 64) - F.floor((F.col("_rank") - 1) / 64)))).first()[0]
    assert copies <= 2 * n // 64 + 2
    assert I.overlapping(rows, ("k",)).agg(F.count("*"), F.max(F.col("seq_b") - F.col("seq_a"))).first() == (n - 1, 1)


def test_segments_cover_what_they_should(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, a, a + rng.randint(1, 20)) for i in range(60) for a in [rng.randrange(50)]]
    got = {(r.k, r.i, r.a, r.b) for r in I.segments(spark.createDataFrame(rows, "k string, i int, s int, e int"), "k", "s", "e").collect()}
    want = set()
    for k in "ab":
        cuts = sorted({t for r in rows if r[0] == k for t in r[2:]})
        want |= {(k, i, a, b) for a, b in zip(cuts, cuts[1:]) for kk, i, s, e in rows if kk == k and s <= a and e >= b}
    assert got == want


def test_conflicts_equal_all_pairs(spark):
    rows = [(k, "ceo", seq, random.Random(seq).choice(["X", "y", "Y ", "z"]), f, t, None, "s") for k, seq, f, t in spans(random.Random(4), 80)]
    df = spark.createDataFrame(rows, "entity string, attribute string, seq long, value string, valid_from timestamp, valid_to timestamp, superseded_at timestamp, source_id string")
    got = sorted((r.entity, r.seq_a, r.seq_b, r.value_a, r.value_b) for r in B.conflicts(df).collect())
    first = {}
    for r in rows:  # copies of a value over one interval count once
        first.setdefault((r[0], r[3].strip().lower(), r[4], r[5]), r)
    kept = sorted(first.values(), key=lambda r: r[2])
    before = lambda a, b: a is None or b is None or a < b
    want = sorted((a[0], a[2], b[2], a[3], b[3]) for i, a in enumerate(kept) for b in kept[i + 1 :] if a[0] == b[0] and a[3].strip().lower() != b[3].strip().lower() and before(a[4], b[5]) and before(b[4], a[5]))
    assert got == want and len(want) > 50


def test_claims_are_paired_and_compared(spark):
    texts = [("d1", "Acme revenue was 5 million in 2023."), ("d2", "Acme revenue was 9 million in 2023."), ("d3", "Globex revenue was 7 million in 2023."), ("d4", "Acme revenue was 5 million in 2023.")]
    found = C.extract(spark.createDataFrame(texts, "doc_id string, text string"))
    got = {tuple(sorted((r.claim_id_a.split(":")[0], r.claim_id_b.split(":")[0]))): r.conflict_type for r in C.contradictions(found).collect()}
    assert got == {("d1", "d2"): "FACTUAL"}  # d4 says what d1 says


def test_many_queries_share_their_frequent_terms(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common, texts = ["revenue", "year", "sales", "total"], []
    for i in range(60):
        texts.append(" ".join([f"name{i // 3}", *rng.choice(common, rng.integers(1, 6)), *(["zeta"] if i == 7 else [])]))
    texts[11] = texts[40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    said = [f"name{i % 25} revenue {common[i % 3 + 1]}" for i in range(40)] + ["zeta", "nothing here", "total revenue"]
    asked = spark.createDataFrame(list(enumerate(said)), "query_id int, text string")
    rows = lambda df: sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in df.collect())
    want = rows(R.top_k(R.bm25(docs, asked).where("score > 0"), 7))
    for docs_at_once, sets, rare in ((5, 4, 3), (8192, 512, 256), (7, 1, 0)):
        monkeypatch.setattr(R, "BLOCK_DOCS", docs_at_once)
        monkeypatch.setattr(R, "BLOCK_SETS", sets)
        monkeypatch.setattr(R, "RARE", rare)
        assert rows(R.bm25_top(docs, asked, 7)) == want


def test_vector_search_holds_a_bounded_part_of_its_scores():
    """A full block of vectors and of queries: their scores would be 512 MB."""
    rng = np.random.default_rng(5)
    x, q = rng.integers(-9, 9, (16384, 4)).astype(float), rng.integers(-9, 9, (4096, 4)).astype(float)
    tracemalloc.start()
    best, score = R.best_scored(len(q), len(x), 10, lambda i, n: q[i : i + n] @ x.T)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    some = q[::511] @ x.T  # whole numbers, with many ties
    want = np.argsort(-some, axis=1, kind="stable")[:, :10]
    assert (best[::511] == want).all() and (score[::511] == np.take_along_axis(some, want, axis=1)).all()
    missing = np.array([[np.nan, 1.0, np.nan, 2.0, 1.0]])
    assert R.best_places(missing, 4).tolist() == [[3, 1, 4, 0]] and R.best_places(missing, 9).tolist() == [[3, 1, 4, 0, 2]]


def test_scores_held_take_a_few_megabytes():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(16384, 8)), rng.normal(size=(256, 8))
    tracemalloc.start()
    R.best_scored(len(q), len(x), 10, lambda i, n: q[i : i + n] @ x.T)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # before: 34 MB
