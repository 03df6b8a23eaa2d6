"""Registered queries over the driver tables; `ORACLE` has the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import evidence as E
from tidemark.functions import metrics as M
from tidemark.functions import temporal as T
from tidemark.functions import text as X
from tidemark.operators import assess as A
from tidemark.operators import bitemporal as B
from tidemark.operators import claims as C
from tidemark.operators import corpus as P
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.operators.staging import new_path, shared_dir, staged
from tidemark.plans import planner as N
from tidemark.sources import readers as S
from tidemark.streaming import detector as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _text(*columns: str):
    return {c: F.col(c).cast("string") for c in columns}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts: a user's last event type."""
    e = S.table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("entity"), F.lit("last_event").alias("attribute"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("valid_from"), F.col("event_id").alias("seq"))


def _beliefs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts that were learnt up to 400 days late."""
    o = S.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("entity"), F.lit("order_status").alias("attribute"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.col("o_orderkey").alias("seq")).withColumn(
        "recorded_at", F.timestamp_add("DAY", (F.col("seq") % 400).cast("int"), F.col("valid_from"))
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as facts that several suppliers report: the quantity of an order's line."""
    li = S.table(spark, sf, "lineitem")
    seq = F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entity"), F.lit("quantity").alias("attribute"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.col("l_suppkey").cast("string").alias("source_id"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), seq.alias("seq"),
    )


_TL = """WITH e AS (SELECT CAST(user_id AS VARCHAR) entity, event_type AS value, ts, event_id, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
tl AS (SELECT entity, value, prev AS previous_value, ts AS vf, event_id AS seq, lead(ts) OVER (PARTITION BY entity ORDER BY ts, event_id) AS vt FROM e WHERE prev IS NULL OR prev <> value) """


@query(_TL + "SELECT entity, value, previous_value, CAST(vf AS VARCHAR) valid_from, CAST(vt AS VARCHAR) valid_to, seq, CASE WHEN previous_value IS NULL THEN 'CREATED' ELSE 'CHANGED' END change_kind FROM tl")
def bt_timeline(spark, sf):
    return B.timeline(_events(spark, sf)).withColumns(_text("valid_from", "valid_to")).drop("attribute")


@query(_TL + "SELECT entity, value, seq FROM tl WHERE vf <= TIMESTAMP '2024-01-15 12:00:00' AND (vt IS NULL OR vt > TIMESTAMP '2024-01-15 12:00:00') QUALIFY row_number() OVER (PARTITION BY entity ORDER BY vf DESC, seq DESC) = 1")
def bt_as_of(spark, sf):
    return B.as_of(B.timeline(_events(spark, sf)), _ts("2024-01-15 12:00:00")).select("entity", "value", "seq")


@query(_TL + "SELECT entity, value, CAST(vf AS VARCHAR) valid_from FROM tl WHERE vt IS NULL")
def bt_current(spark, sf):
    got = B.latest(B.timeline(_events(spark, sf)).withColumn("recorded_at", F.col("valid_from")), _ts("2030-01-01"))
    return got.where("still_valid").select("entity", "value", F.col("valid_from").cast("string").alias("valid_from"))


@query(_TL + "SELECT entity, value, seq FROM tl WHERE vt IS NOT NULL")
def bt_outdated(spark, sf):
    return B.outdated(B.timeline(_events(spark, sf)), _ts("2030-01-01")).select("entity", "value", "seq")


@query(_TL + "SELECT entity, value, previous_value, CAST(vf AS VARCHAR) valid_from, CAST(vt AS VARCHAR) valid_to, seq FROM tl")
def bt_fold_in_order(spark, sf):
    facts = _events(spark, sf).withColumns({"recorded_at": F.col("valid_from"), "source_id": F.lit("events")})
    return B.assert_facts(facts).withColumns(_text("valid_from", "valid_to")).select("entity", "value", "previous_value", "valid_from", "valid_to", "seq")


@query(ORACLE["bt_fold_in_order"])
def stream_fold(spark, sf):
    """The same facts as a stream whose files come in an order that has nothing to do with their times."""
    from tidemark.streaming.fold import CHANGES, fold_stream, versions_of

    facts = _events(spark, sf).withColumns({"recorded_at": F.col("valid_from"), "source_id": F.lit("events"), "arrival": F.pmod(F.xxhash64("seq"), F.lit(4))})
    folder = new_path(spark, "stream")
    facts.write.partitionBy("arrival").parquet(f"{folder}/facts")
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 2 * spark.sparkContext.defaultParallelism).parquet(f"{folder}/facts")
    changes = fold_stream(stream).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint")
    changes.trigger(availableNow=True).start().awaitTermination()
    got = versions_of(spark.read.schema(CHANGES).parquet(f"{folder}/changes"))
    return got.withColumns(_text("valid_from", "valid_to")).select("entity", "value", "previous_value", "valid_from", "valid_to", "seq")


@query()
def bt_fold_out_of_order(spark, sf):
    """The general fold; SQL has no order-dependent fold. Tests hold it against a model in Python."""
    return B.assert_facts(_beliefs(spark, sf).withColumn("source_id", F.col("value")), "bitemporal").withColumns(_text("valid_from", "valid_to", "recorded_at", "superseded_at"))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) entity, o_orderstatus AS value, o_orderkey AS seq FROM orders
WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate + to_days(CAST(o_orderkey % 400 AS INT)) <= TIMESTAMP '1998-03-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def bt_belief_as_of(spark, sf):
    none = F.lit(None).cast("timestamp")
    versions = _beliefs(spark, sf).withColumns({"valid_to": none, "superseded_at": none})
    return B.as_of(versions, _ts("1998-01-01"), _ts("1998-03-01")).select("entity", "value", "seq")


@query(
    """WITH d AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber) entity, CAST(l_quantity AS INT) v FROM lineitem)
SELECT a.entity, CAST(a.v AS BIGINT) AS low, CAST(b.v AS BIGINT) AS high FROM d a JOIN d b ON a.entity = b.entity AND a.v < b.v"""
)
def bt_conflicts(spark, sf):
    a, b = F.col("value_a").cast("long"), F.col("value_b").cast("long")
    return B.conflicts(_lines(spark, sf)).select("entity", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


@query(
    """WITH d AS (SELECT concat_ws('-', l_orderkey, l_linenumber) entity, CAST(l_quantity AS INT) v FROM lineitem GROUP BY ALL), p AS (SELECT a.entity, a.v x, b.v y FROM d a JOIN d b ON a.entity = b.entity AND a.v < b.v)
SELECT CASE WHEN (y - x) / CAST(y AS DOUBLE) > 0.02 THEN 'FACTUAL' ELSE 'NONE' END conflict_type, count(*) n FROM p GROUP BY 1"""
)
def bt_conflict_types(spark, sf):
    return B.classify_conflicts(B.conflicts(_lines(spark, sf))).groupBy("conflict_type").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderdate, o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) p FROM orders)
SELECT o_orderkey AS seq, p IS NOT NULL AND p <> o_totalprice AS restatement FROM r"""
)
def restatement_flags(spark, sf):
    o = S.table(spark, sf, "orders")
    none = F.lit("")
    rows = o.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("attribute"), none.alias("valid_from"), none.alias("valid_to"), F.col("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accn"), F.col("o_totalprice").alias("value"))
    return S.restatements(rows).select(F.col("accn").alias("seq"), "restatement")


@query(_TL + "SELECT 'last_event' AS attribute, CAST(greatest(1, list_sort(list(d))[len(list(d)) // 2 + 1]) AS DOUBLE) halflife_days FROM (SELECT CAST(floor((epoch_us(vt) - epoch_us(vf)) / 86400000000.0) AS BIGINT) d FROM tl WHERE vt IS NOT NULL)")
def halflife_median(spark, sf):
    return B.estimate_halflife(B.timeline(_events(spark, sf)))


@query(
    """WITH o AS (SELECT o_orderkey AS seq, o_orderdate s, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL 90 DAY END e, TIMESTAMP '2000-01-01' t, TIMESTAMP '1997-01-01' r0, TIMESTAMP '1998-01-01' r1 FROM orders),
d AS (SELECT *, (epoch_us(t) - epoch_us(s)) / 86400000000.0 ts, (epoch_us(t) - epoch_us(e)) / 86400000000.0 te FROM o)
SELECT seq, round(pow(0.5, greatest(0, ts) / 240.0), 6) AS freshness,
round(CASE WHEN e IS NULL THEN 1.0 WHEN e >= t THEN 0.9 ELSE 0.4 * pow(0.5, floor(te) / 365.25) END, 6) AS current_score,
round(CASE WHEN s <= t AND (e IS NULL OR t < e) THEN 1.0 ELSE pow(0.5, coalesce(least(abs(floor(ts)), abs(floor(te))), abs(floor(ts))) / 365.25) END, 6) AS historical_score,
round(greatest(0, least(1, (epoch_us(least(coalesce(e, r1), r1)) - epoch_us(greatest(s, r0))) / 86400000000.0 / 365.0)), 6) AS range_score,
CASE WHEN e IS NULL THEN 0.75 ELSE 1.0 END AS change_score FROM d"""
)
def freshness_and_overlap(spark, sf):
    ref, o = _ts("2000-01-01"), S.table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    end = F.when(F.col("o_orderkey") % 3 > 0, F.timestamp_add("DAY", F.lit(90), F.col("at")))
    score = lambda intent: F.round(T.overlap_score(F.col("at"), end, intent, ref, _ts("1997-01-01"), _ts("1998-01-01")), 6)
    return o.select(
        F.col("o_orderkey").alias("seq"), F.round(T.freshness(F.col("at"), ref, F.lit(240.0)), 6).alias("freshness"),
        *[score(i).cast("double").alias(f"{i.lower()}_score") for i in ("CURRENT", "HISTORICAL", "RANGE", "CHANGE")],
    )


@query(_TL + "SELECT entity, previous_value AS old_value, value AS new_value, CAST(vf AS VARCHAR) detected_at FROM tl WHERE previous_value IS NOT NULL ORDER BY vf DESC, entity, value LIMIT 100")
def change_feed(spark, sf):
    ev = B.timeline(_events(spark, sf)).where("change_kind = 'CHANGED'").select("entity", "attribute", F.col("change_kind").alias("kind"), F.col("previous_value").alias("old_value"), F.col("value").alias("new_value"), F.col("valid_from").alias("detected_at"))
    return B.change_feed(ev, 100, "CHANGED").select("entity", "old_value", "new_value", F.col("detected_at").cast("string").alias("detected_at"))


@query(_TL + "SELECT entity, value, seq FROM tl WHERE previous_value IS NOT NULL AND vf BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def changes_between(spark, sf):
    return B.changes_between(B.timeline(_events(spark, sf)), _ts("2024-01-05"), _ts("2024-01-06")).select("entity", "value", "seq")


_DAY = "(SELECT CAST(user_id AS VARCHAR) entity, arg_max(event_type, (ts, event_id)) v FROM events WHERE ts < TIMESTAMP '{}' GROUP BY 1)"


@query(f"SELECT coalesce(a.entity, b.entity) entity, a.v AS old_value, b.v AS new_value, CASE WHEN a.v IS NULL THEN 'added' ELSE 'modified' END kind FROM {_DAY.format('2024-01-10')} a FULL JOIN {_DAY.format('2024-01-20')} b ON a.entity = b.entity WHERE a.v IS DISTINCT FROM b.v")
def change_diff(spark, sf):
    e = _events(spark, sf)
    state = lambda t: e.where(F.col("valid_from") < _ts(t)).groupBy("entity", "attribute").agg(F.max_by("value", F.struct("valid_from", "seq")).alias("value"))
    return D.claim_diff(state("2024-01-10"), state("2024-01-20")).drop("attribute")


@query(
    """WITH p AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) entity, ts + INTERVAL 1 HOUR AS t FROM events), """
    + _TL.removeprefix("WITH ")
    + "SELECT p.id, tl.value FROM p ASOF LEFT JOIN tl ON p.entity = tl.entity AND p.t >= tl.vf"
)
def as_of_join(spark, sf):
    points = _events(spark, sf).select("entity", "attribute", F.timestamp_add("HOUR", F.lit(1), F.col("valid_from")).alias("t"), F.col("seq").alias("id"))
    return B.as_of_join(points, B.timeline(_events(spark, sf))).select("id", "value")


_TOK = r"list_filter(regexp_extract_all(lower({}), '[a-z0-9]+(?:[-_.''][a-z0-9]+)*'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "))"
_BM25 = f"""WITH d AS (SELECT doc_id, {_TOK.format('text')} t FROM documents), n AS (SELECT count(*) n_docs, avg(len(t)) al FROM d), p AS (SELECT doc_id, len(t) dl, unnest(t) term FROM d), tf AS (SELECT doc_id, dl, term, count(*) tf FROM p GROUP BY ALL),
q AS (SELECT item_id, term, count(*) qf FROM (SELECT item_id, unnest({_TOK.format('text')}) term FROM benchmark) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
s AS (SELECT item_id query_id, doc_id, round(sum(qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(al, 1e-9)))), 9) score FROM tf JOIN q USING (term) JOIN df USING (term), n GROUP BY ALL),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM s QUALIFY rank <= 10) """


def _bm25(spark, sf, k=10):
    docs, bench = S.table(spark, sf, "documents"), S.table(spark, sf, "benchmark")
    return R.bm25_top(docs, bench.select(F.col("item_id").alias("query_id"), "text"), k)


@query(_BM25 + "SELECT query_id, doc_id, rank, round(score, 4) score FROM top")
def bm25_topk(spark, sf):
    return _bm25(spark, sf).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(
    _BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 3)", 1) + "SELECT query_id, doc_id, rank, round(score, 4) score FROM top"
)
def text_index_topk(spark, sf):
    """BM25 over an index that took the documents in three batches, some of them first with another's text, and from which every seventh was deleted."""
    docs, bench = S.table(spark, sf, "documents").select("doc_id", "text"), S.table(spark, sf, "benchmark")
    index = R.TextIndex(spark, new_path(spark, "text-index"))
    for batch in range(3):
        mine = docs.where(F.col("doc_id") % 3 == batch)
        later = docs.where((F.col("doc_id") % 3 == batch + 1) & (F.col("doc_id") % 5 == 0)).withColumn("text", F.reverse("text"))
        index.add(mine.unionByName(later))
    index.delete(docs.where("doc_id % 7 = 3").select("doc_id"))
    return index.top(bench.select(F.col("item_id").alias("query_id"), "text"), 10).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


_VEC = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings), q AS (SELECT vec_id query_id, label ql, v q FROM u WHERE vec_id % 20 = 0),
s AS (SELECT query_id, ql, vec_id, label, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) score FROM u, q),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s QUALIFY rank <= 10) """


def _vec(spark, sf, k=10, **more):
    e = S.table(spark, sf, "embeddings")
    return R.vector_top(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k, **more)


@query(_VEC + "SELECT query_id, vec_id, rank, round(score, 5) score FROM top")
def vec_topk(spark, sf):
    return _vec(spark, sf).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query(
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: round_even(x / greatest(sqrt(list_dot_product(v, v)), 1e-12) * 127, 0)) v FROM u),
s AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(c.v, q.v) score FROM c, (SELECT * FROM c WHERE vec_id % 20 = 0) q)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank, round(score / 16129, 5) score FROM s QUALIFY rank <= 10"""
)
def vec_int8(spark, sf):
    return _vec(spark, sf, code=True).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query()
def vec_ivf(spark, sf):
    """Search by an inverted file of int8 codes, probing as many cells as a recall of 0.95 took when it was built; a test holds this query against the exact search."""
    e = S.table(spark, sf, "embeddings")
    return R.ivf_top(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


_HYB = _BM25.rstrip() + ", " + _VEC.removeprefix("WITH ").replace("q AS (SELECT vec_id", "vq AS (SELECT vec_id").replace("FROM u, q)", "FROM u, vq)").replace("s AS (SELECT query_id, ql", "vs AS (SELECT query_id, ql").replace("FROM s QUALIFY", "FROM vs QUALIFY").replace("top AS (SELECT *", "vtop AS (SELECT *")


def _hits(spark, sf):
    """Vector and text hits of shared query ids (vec_id taken for doc_id: an arbitrary pairing)."""
    return _vec(spark, sf).withColumnRenamed("vec_id", "doc_id"), _bm25(spark, sf).where("query_id % 20 = 0")


@query(_HYB + "SELECT query_id, doc_id, round(sum(w / (60 + rank)), 6) score FROM (SELECT query_id, vec_id doc_id, rank, 1.0 w FROM vtop UNION ALL SELECT query_id, doc_id, rank, 0.5 FROM top WHERE query_id % 20 = 0) GROUP BY ALL")
def rrf_fusion(spark, sf):
    dense, sparse = _hits(spark, sf)
    return R.rrf([(dense, 1.0), (sparse, 0.5)]).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    _HYB + """, c AS (SELECT coalesce(a.query_id, b.query_id) query_id, coalesce(a.vec_id, b.doc_id) doc_id, coalesce(a.score, 0) dense, coalesce(b.score, 0) sparse FROM vtop a FULL JOIN (SELECT * FROM top WHERE query_id % 20 = 0) b ON a.query_id = b.query_id AND a.vec_id = b.doc_id),
m AS (SELECT *, min(dense) OVER w d0, max(dense) OVER w d1, min(sparse) OVER w s0, max(sparse) OVER w s1 FROM c WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc_id, round((CASE WHEN d1 - d0 < 1e-9 THEN 0 ELSE (dense - d0) / (d1 - d0) END + CASE WHEN s1 - s0 < 1e-9 THEN 0 ELSE (sparse - s0) / (s1 - s0) END) / 2, 4) score FROM m"""
)
def weighted_fusion(spark, sf):
    fused = R.weighted_fuse(R.union_candidates(*_hits(spark, sf)))
    return fused.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(_VEC + "SELECT query_id, label AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank), label) AS INT) rank FROM top GROUP BY query_id, label")
def document_ranking(spark, sf):
    """Vectors as the chunks of their labels: the ranking of labels."""
    parts = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"))
    return R.ranked_documents(_vec(spark, sf).withColumnRenamed("vec_id", "doc_id"), parts)


@query(
    _VEC + """, r AS (SELECT * FROM top WHERE vec_id <> query_id), g AS (SELECT q.query_id, count(*) n_gold, sum(CASE WHEN rn <= 10 THEN 1 / log2(rn + 1) END) idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) rn FROM q JOIN u ON q.ql = u.label) q GROUP BY 1)
SELECT g.query_id, round(count(*) FILTER (label = ql) / n_gold::DOUBLE, 5) recall, round(count(*) FILTER (label = ql) / count(*)::DOUBLE, 5) "precision", round(max(CASE WHEN label = ql THEN 1.0 / rank ELSE 0 END), 5) mrr, round(sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END) / idcg, 5) ndcg FROM g JOIN r ON g.query_id = r.query_id GROUP BY g.query_id, n_gold, idcg"""
)
def ranking_measures(spark, sf):
    e = S.table(spark, sf, "embeddings")
    gold = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id", F.lit(1.0).alias("relevance"))
    ranked = _vec(spark, sf).where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    got = R.ranking_measures(ranked, gold, 10)
    return got.select("query_id", *[F.round(c, 5).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


@query(
    r"""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') w FROM documents)
SELECT doc_id, length(text) >= 200 AND length(regexp_replace(text, '[^\p{L} \t\n\x0b\f\r]', '', 'g')) / length(text) >= 0.7 AND len(w) > 0 AND length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')) / len(w) >= 2.5 AND len(list_distinct(w)) / len(w) >= 0.25 AS keep FROM t"""
)
def quality_filter(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.quality_ok(F.col("text")).alias("keep"))


@query()
def clean_texts(spark, sf):
    """NFKC has no counterpart in SQL; tests hold it against Python's."""
    return S.table(spark, sf, "documents").select("doc_id", X.clean_text("text").alias("text"))


@query("SELECT min(doc_id) doc_id, count(*) copies FROM documents GROUP BY text")
def exact_dedup(spark, sf):
    return P.exact_dedup(S.table(spark, sf, "documents")).select("doc_id", "copies")


@query()
def near_dedup_minhash(spark, sf):
    """MinHash bands use Spark's hash family; tests hold the links against exact similarity."""
    shared_dir(spark)
    return P.near_duplicates(S.table(spark, sf, "documents"))


@query(
    r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM pages"
)
def html_text(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query()
def sentence_spans(spark, sf):
    """Cuts need lookbehind, which DuckDB's patterns lack; tests hold the spans against the texts."""
    return S.table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "s")).select("doc_id", "n", "s.*")


@query()
def text_chunks(spark, sf):
    """Greedy packing is sequential; tests hold bounds and offsets."""
    return P.chunks(S.table(spark, sf, "documents"))


_EDGE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"  # DuckDB's \b knows ASCII letters alone
_BOUND = lambda pattern: "(?i)" + pattern.removeprefix("(?i)").replace(r"\b", _EDGE[0], 1).removesuffix(r"\b") + _EDGE[1]
_ATTR = "CASE " + " ".join(rf"WHEN regexp_matches(lower(text), '{_EDGE[0]}({'|'.join(w)}){_EDGE[1]}') THEN '{a}'" for a, w in E.ATTRIBUTES.items()) + " ELSE '' END"


@query(f"SELECT doc_id, {_ATTR} attribute, regexp_matches(text, '{_BOUND(E.HEDGE)}') hedged, NOT regexp_matches(text, '{_BOUND(E.OPINION)}') checkable FROM documents")
def claim_flags(spark, sf):
    t = F.col("text")
    return S.table(spark, sf, "documents").select("doc_id", E.attribute(t).alias("attribute"), E.hedged(t).alias("hedged"), E.checkable(t).alias("checkable"))


_NUMSQL = r"TRY_CAST(replace(regexp_extract({0}, '{1}', 2), ',', '') AS DOUBLE) * CASE lower(regexp_extract({0}, '{1}', 3)) WHEN 'billion' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1 END".replace("{1}", E.NUMBER.replace(r"\s", r"[ \t\n\x0b\f\r]"))


@query(f"SELECT conv_id, turn, {_NUMSQL.format('text')} AS numeric FROM conversations")
def claim_numbers(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", "turn", E.number(F.col("text")).alias("numeric"))


@query()
def claims_extracted(spark, sf):
    """Clauses and Python's number format keep this out of SQL; tests use inline sentences."""
    return C.extract(S.table(spark, sf, "documents").select("doc_id", "text"))


_CT = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in E.CONTENT_STOP) + ")))"
_ROUTED = _BM25 + f", r AS (SELECT top.query_id, top.doc_id, {_CT.format('b.text')} c, {_CT.format('d2.text')} e, b.text bt, d2.text dt FROM top JOIN benchmark b ON b.item_id = top.query_id JOIN documents d2 ON d2.doc_id = top.doc_id)"


def _routed(spark, sf):
    items = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("claim"))
    hits = staged(_bm25(spark, sf).select("query_id", "doc_id"), "hits")  # k for each item; claims and evidence both come from them
    return hits.join(items, "query_id").join(S.table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")


@query(_ROUTED + "SELECT query_id, round(max(CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(c, e)) / len(c)::DOUBLE END), 6) entailment FROM r GROUP BY 1")
def lexical_entailment(spark, sf):
    c = E.coverage(E.content_tokens(F.col("claim")), E.content_tokens(F.col("text")))
    return _routed(spark, sf).groupBy("query_id").agg(F.round(F.max(c), 6).alias("entailment"))


def _claims_and_evidence(spark, sf):
    r = _routed(spark, sf).withColumn("claim_id", F.col("query_id").cast("string"))
    c = r.select("claim_id", F.col("claim").alias("text")).distinct()
    c = c.withColumns({"numeric": E.number(F.col("text")), "attribute": E.attribute(F.col("text")), "value": F.lit(""), "checkable": E.checkable(F.col("text"))})
    return c, r.select("claim_id", "doc_id", "source", "text", F.lit(None).cast("timestamp").alias("valid_to"))


@query()
def claim_verdicts(spark, sf):
    """The whole ladder; tests hold it on inline claims."""
    return C.verify(*_claims_and_evidence(spark, sf))


@query()
def verdict_measures(spark, sf):
    return C.verdict_measures(C.verify(*_claims_and_evidence(spark, sf)))


def _statements(spark, sf, k_of_value):
    """(k, said, r) of suppliers' revenue in 1996; figures are the only numbers in a statement, so names are spelt in letters."""
    rows = S.table(spark, sf, "lineitem").where(F.year("l_shipdate") == 1996).groupBy(F.col("l_suppkey").alias("k")).agg(F.expr("sum(cast(round(l_extendedprice * 100) as long)) div 100").alias("r"))
    name = F.concat(F.lit("Supplier"), F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij"))
    return rows.select("k", F.concat(name, F.lit(" revenue was "), (F.col("r") * k_of_value(F.col("k"))).cast("string"), F.lit(" USD in that year.")).alias("said"))


@query(
    """SELECT l_suppkey AS query_id, CASE l_suppkey % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' WHEN 2 THEN 'CONFLICTED' ELSE 'TEMPORAL_MISMATCH' END verdict, CASE WHEN l_suppkey % 4 = 1 THEN 0.8 ELSE 1.0 END entailment,
CASE WHEN l_suppkey % 4 IN (0, 2) THEN 1 ELSE 0 END n_independent, CASE WHEN l_suppkey % 4 = 2 THEN 2 ELSE 1 END n_evidence FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1"""
)
def claims_judged(spark, sf):
    """Statements about every supplier, right or doubled, extracted as claims, routed to the evidence about their subject, and judged by the whole ladder.

    By the number of a supplier: a right one, a doubled one against the record, one that two sources differ on, one whose evidence has run out.
    """
    k, none = F.col("k"), F.lit(None).cast("timestamp")
    said = _statements(spark, sf, lambda k: F.when(k % 4 % 3 == 0, 1).otherwise(2))
    record = _statements(spark, sf, lambda k: F.lit(1)).select(k, F.concat_ws("-", k, F.lit("record")).alias("doc_id"), F.col("said").alias("text"), F.lit("sec.gov").alias("source"), F.when(k % 4 == 3, _ts("1996-12-31")).alias("valid_to"))
    other = said.where(k % 4 == 2).select(k, F.concat_ws("-", k, F.lit("other")).alias("doc_id"), F.col("said").alias("text"), F.lit("wire.com").alias("source"), none.alias("valid_to"))
    evidence = record.unionByName(other).select(k.alias("query_id"), "doc_id", "text", "source", none.alias("valid_from"), "valid_to")
    claims = C.extract(said.select(F.concat_ws("-", k, F.lit("said")).alias("doc_id"), F.col("said").alias("text"), k.alias("query_id")), carry=("query_id",))
    dated = claims.withColumns({c: F.try_to_timestamp(c) for c in ("valid_from", "valid_to")})
    pairs = A.route(dated, evidence).select("query_id", "claim_id", "doc_id", "source", F.col("etext").alias("text"), "valid_to")
    judged = C.verify(claims, pairs, _ts("1997-01-01"))
    return judged.join(claims.select("claim_id", "query_id"), "claim_id").select("query_id", "verdict", F.round("entailment", 6).alias("entailment"), "n_independent", "n_evidence")


_TIER = lambda c, d: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{'|'.join(E.TIERS[d][t])}') THEN {t}" for t in (1, 2, 3, 4)) + " ELSE 3 END"


@query(f"SELECT page_id, {', '.join(f'{_TIER('url', d)} AS {d}' for d in E.TIERS)} FROM pages")
def source_tiers(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", *[E.tier(F.col("url"), d).alias(d) for d in E.TIERS])


@query(
    r"""WITH f AS (SELECT lang query_id, count(DISTINCT source) n, max(CASE WHEN regexp_matches(text, '"""
    + E.SECONDHAND
    + r"""') THEN 0.45 ELSE 1.0 END) directness, max(least(1.0, 0.4 + 0.3 * len(regexp_extract_all(text, '"""
    + E.SPECIFIC.replace(r"\s", "[ ]").replace("(\\d{4}", "(?:\\d{4}")
    + r"""')))) specificity, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END) validity FROM documents GROUP BY 1),
a AS (SELECT lang query_id, max(c) / sum(c)::DOUBLE agreement FROM (SELECT lang, doc_id % 3 v, count(*) c FROM documents GROUP BY ALL) GROUP BY 1)
SELECT query_id, n AS n_independent, round(least(1, greatest(0, 0.2 * 0.5 + 0.12 * 0.3 + 0.22 * (least(1, ln(1 + n) / ln(7)) * 0.4 + least(1, n / 3.0) * 0.6) + 0.14 * directness + 0.08 * specificity + 0.16 * agreement + 0.08 * validity)), 5) score FROM f JOIN a USING (query_id)"""
)
def evidence_score(spark, sf):
    d = S.table(spark, sf, "documents")
    rows = d.select(F.col("lang").alias("query_id"), "source", F.lit(None).cast("timestamp").alias("date"), "text", (F.col("doc_id") % 3).cast("string").alias("value"), (F.col("n_chars") > 1000).alias("fresh"))
    return C.score_evidence(rows, _ts("2024-01-01")).select("query_id", "n_independent", F.round("score", 5).alias("score"))


_EDGES = "SELECT CAST(p_partkey AS VARCHAR) src, CAST(p_partkey // 3 AS VARCHAR) dst FROM part WHERE p_partkey % 7 <> 0 AND p_partkey // 3 > 0"


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src id FROM e UNION SELECT dst FROM e), r(id, up, d) AS (SELECT id, id, 0 FROM n UNION ALL SELECT r.id, e.dst, d + 1 FROM r JOIN e ON r.up = e.src WHERE d < 8)
SELECT id, arg_max(up, d) AS root FROM r GROUP BY id"""
)
def provenance_roots(spark, sf):
    p = S.table(spark, sf, "part").where("p_partkey % 7 <> 0 and p_partkey div 3 > 0")
    edges = p.select(F.col("p_partkey").cast("string").alias("src"), F.expr("p_partkey div 3").cast("string").alias("dst"), F.lit("DERIVED_FROM").alias("etype"))
    return G.roots(edges)


@query("SELECT l_returnflag AS claim, count(DISTINCT l_suppkey % 50) n_independent FROM lineitem GROUP BY 1")
def independent_sources(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    doc = F.concat(F.lit("doc:"), F.col("l_suppkey"))
    backs = li.select(doc.alias("src"), F.col("l_returnflag").alias("dst"), F.lit("SUPPORTS").alias("etype"))
    published = li.select(doc.alias("src"), F.concat(F.lit("src:"), F.col("l_suppkey") % 50).alias("dst"), F.lit("PUBLISHED_BY").alias("etype")).distinct()
    return G.independent_sources(backs.union(published), "reference")


@query(
    """WITH RECURSIVE d AS (SELECT DISTINCT l_suppkey k, l_returnflag claim FROM lineitem), r(k, up) AS (SELECT DISTINCT k, k FROM d UNION ALL SELECT k, up // 3 FROM r WHERE up % 7 <> 0 AND up // 3 > 0)
SELECT claim, count(DISTINCT root) n_independent FROM d JOIN (SELECT k, min(up) root FROM r GROUP BY 1) USING (k) GROUP BY 1"""
)
def independent_origins(spark, sf):
    """Documents behind each claim by what they derive from: number k from k div 3, unless 7 divides k."""
    li = S.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    doc = lambda k: F.concat(F.lit("doc:"), F.lpad(k.cast("string"), 12, "0"))
    backs = li.select(doc(F.col("l_suppkey")).alias("src"), F.col("l_returnflag").alias("dst"), F.lit("SUPPORTS").alias("etype"))
    numbers = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).where("k % 7 <> 0 and k div 3 > 0")
    derived = numbers.select(doc(F.col("k")).alias("src"), doc(F.expr("k div 3")).alias("dst"), F.lit("DERIVED_FROM").alias("etype"))
    return G.independent_sources(backs.union(derived))


@query("SELECT conv_id, '<|bos|>' || string_agg('<|' || role || '|>' || text, '' ORDER BY turn, role, text) || '<|eos|>' AS rendered, count(*) n_turns FROM conversations GROUP BY 1")
def chat_render(spark, sf):
    return P.render_chat(S.table(spark, sf, "conversations"))


@query("SELECT conv_id, CAST(sum(length(text) + 1) + 2 AS BIGINT) n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) + 1 AS BIGINT) n_trained FROM conversations GROUP BY 1")
def chat_loss_mask(spark, sf):
    return P.loss_mask(S.table(spark, sf, "conversations"), F.length("text"))


_W = r"SELECT unnest(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^ \t\n\x0b\f\r\p{L}\p{N}]+|[ \t\n\x0b\f\r]+')) word FROM documents"


@query(f"SELECT word, count(*) n FROM ({_W}) GROUP BY 1")
def bpe_word_counts(spark, sf):
    return P.word_counts(S.table(spark, sf, "documents"))


@query(f"SELECT word[i:i+1] AS pair, CAST(sum(n) AS BIGINT) n FROM (SELECT word, n, unnest(range(1, length(word))) i FROM (SELECT word, count(*) n FROM ({_W}) GROUP BY 1) WHERE length(word) > 1) GROUP BY 1")
def bpe_pair_counts(spark, sf):
    return P.pair_counts(P.word_counts(S.table(spark, sf, "documents")))


@query()
def bpe_encoded(spark, sf):
    """Merges are learnt in sequence; tests hold the round trip."""
    docs = S.table(spark, sf, "documents")
    bpe = P.Bpe.train(P.word_counts(docs), 600)
    return docs.select("doc_id", bpe.column(F.col("text")).alias("ids")).select("doc_id", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"))


@query(
    """WITH c AS (SELECT n_chars < 1200 AS refused, quality = 0 AS should FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (refused AND should) tp, count(*) FILTER (refused AND NOT should) fp, count(*) FILTER (NOT refused AND should) fn FROM c)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2.0 * tp / (2 * tp + fp + fn), 6) f1 FROM n"""
)
def abstention_scores(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id")
    return M.abstention(d, F.col("n_chars") < 1200, F.col("quality") == 0).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT n_name AS entity, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def compare_entities(spark, sf):
    t = lambda n: S.table(spark, sf, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_nationkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("entity"), "year", F.round("r", 2).alias("revenue"))


@query(
    """WITH m AS (SELECT c_nationkey, o_orderpriority p, sum(o_totalprice) n, min(o_orderdate) f, max(o_orderdate) t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey AS query_id, count(*) n_entities, arg_max(p, n) highest, arg_min(p, n) lowest, round(max(n) - min(n), 2) gap, round(max(n) / min(n), 6) ratio, date_diff('day', min(f), max(f)) <= 7 AND date_diff('day', min(t), max(t)) <= 7 aligned FROM m GROUP BY 1"""
)
def compared_amounts(spark, sf):
    """Order priorities of a nation as the entities that are compared."""
    o = S.table(spark, sf, "orders").join(S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.groupBy(F.col("c_nationkey").alias("query_id"), F.col("o_orderpriority").alias("entity")).agg(F.sum("o_totalprice").alias("n"), F.min("o_orderdate").alias("valid_from"), F.max("o_orderdate").alias("valid_to"))
    return A.compared_amounts(rows).withColumns({"gap": F.round("gap", 2), "ratio": F.round("ratio", 6)})


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS normal FROM documents")
def normal_answers(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.norm_answer(F.col("text")).alias("normal"))


@query(r"SELECT c_custkey AS id, trim(regexp_replace(replace(lower(trim(c_name || ', ' || c_mktsegment)), ',', ''), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS normal FROM customer")
def normal_values(spark, sf):
    return S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.norm_value(F.concat("c_name", F.lit(", "), "c_mktsegment")).alias("normal"))


@query(
    "WITH b AS (SELECT user_id, event_type, ts, event_id, lag(event_type || ' ' || CAST(value > 50 AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id) p, event_type || ' ' || CAST(value > 50 AS VARCHAR) t FROM events) SELECT event_id AS seq, CASE WHEN p IS NULL THEN 'first-seen' WHEN p = t THEN 'identical-content' ELSE 'content-change' END reason FROM b"
)
def poll_suppression(spark, sf):
    e = S.table(spark, sf, "events")
    polls = e.select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", (F.col("value") > 50).cast("string")).alias("text"))
    return D.detect_batch(polls).select("seq", "reason")


@query(
    "SELECT user_id, CAST(count(*) AS BIGINT) polls, CAST(trunc(CASE WHEN count(*) < 3 THEN 3600 ELSE greatest(300, least(604800, CASE WHEN ch / count(*) < 0.5 THEN 3600 / greatest(ch / count(*), 0.01) ELSE 3600 * (ch / count(*)) END)) END) AS BIGINT) AS seconds FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) ch FROM events) GROUP BY user_id, ch"
)
def poll_intervals(spark, sf):
    per = S.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("polls"), F.count_if(F.col("event_type") == "purchase").alias("changes"))
    return per.select("user_id", "polls", T.next_poll_seconds(F.col("polls"), F.col("changes")).cast("long").alias("seconds"))


def _cue(cues):
    return f"regexp_matches(lower(text), '{_EDGE[0]}({'|'.join(c.replace('.', chr(92) + '.') for c in cues)}){_EDGE[1]}')"


_TIMED = lambda pattern: f"regexp_matches(lower(text), '{_EDGE[0]}{pattern.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}{_EDGE[1]}')"


@query(
    f"""SELECT conv_id, turn, CASE WHEN {_TIMED(N.RANGE)} OR {_TIMED(N.RELATIVE)} THEN 'RANGE' WHEN {_cue(N.CHANGE_CUES)} THEN 'CHANGE' WHEN {_cue(N.CURRENT_CUES)} THEN 'CURRENT'
WHEN {_TIMED(N.YEAR)} OR {_TIMED(N.MONTH_YEAR)} THEN CASE WHEN contains(lower(text), 'as of') THEN 'AS_OF' ELSE 'HISTORICAL' END WHEN {_cue(N.PAST_CUES)} THEN 'HISTORICAL' ELSE 'CURRENT' END intent FROM conversations"""
)
def question_intents(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", "turn", N.time_asked(F.coalesce("text", F.lit("")), _ts("2026-06-01"))["intent"].alias("intent"))


@query(
    """WITH sp AS (SELECT CAST(o_custkey AS VARCHAR) entity, o_orderpriority v, o_orderdate s, o_orderdate + INTERVAL 200 DAY e FROM orders), c AS (SELECT entity, a, lead(a) OVER (PARTITION BY entity ORDER BY a) b FROM (SELECT DISTINCT entity, unnest([s, e]) a FROM sp)),
act AS (SELECT c.entity, a, b, v, s, e FROM c JOIN sp ON c.entity = sp.entity AND s <= a AND e >= b), k AS (SELECT * FROM act x WHERE NOT EXISTS (SELECT 1 FROM act y WHERE y.entity = x.entity AND y.a = x.a AND y.s > x.s AND date_diff('day', y.s, x.e) < 90)),
h AS (SELECT entity, a, b, string_agg(v, ' and ' ORDER BY f, v) || CASE WHEN count(*) > 1 THEN ' (co-CEOs)' ELSE '' END v FROM (SELECT entity, a, b, v, min(s) f FROM k GROUP BY ALL) GROUP BY ALL),
n AS (SELECT *, coalesce(lag(v) OVER w <> v OR lag(b) OVER w <> a, true) fresh FROM h WINDOW w AS (PARTITION BY entity ORDER BY a)), m AS (SELECT entity, any_value(v) v, min(a) a, max(b) b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY entity ORDER BY a) g FROM n) GROUP BY entity, g)
SELECT entity, v AS value, CAST(a AS VARCHAR) valid_from, CASE WHEN coalesce(date_diff('day', b, lead(a) OVER (PARTITION BY entity ORDER BY a)) <= 1, false) THEN NULL ELSE CAST(b AS VARCHAR) END valid_to FROM m"""
)
def tenures_cut(spark, sf):
    """Customers' orders as tenures of 200 days."""
    o = S.table(spark, sf, "orders").join(S.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("o_custkey").cast("string").alias("entity"), "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("valid_from"))
    rows = rows.select("entity", F.col("o_orderpriority").alias("value"), "valid_from", F.timestamp_add("DAY", F.lit(200), F.col("valid_from")).alias("valid_to"))
    return B.tenure_segments(rows).withColumns(_text("valid_from", "valid_to"))


@query(
    """SELECT o_orderkey AS accn, o_orderpriority AS tag FROM (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 99 END) r FROM orders) WHERE r = 1"""
)
def preferred_tags(spark, sf):
    o = S.table(spark, sf, "orders")
    tag = F.when(F.col("o_orderpriority") == "1-URGENT", "Revenues").otherwise(F.col("o_orderpriority"))
    rows = o.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("attribute"), F.lit("").alias("valid_from"), F.lit("").alias("valid_to"), F.lit("").alias("accn"), tag.alias("tag"), "o_orderkey", "o_orderpriority")
    return S.prefer_tags(rows).select(F.col("o_orderkey").alias("accn"), F.col("o_orderpriority").alias("tag"))


@query("SELECT doc_id, CASE WHEN sum(n_chars) OVER (ORDER BY doc_id) > 0.99 * sum(n_chars) OVER () THEN 'val' ELSE 'train' END split FROM documents")
def shard_split(spark, sf):
    return P.tail_split(S.table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "split")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    out = D.windowed_counts(S.table(spark, sf, "events"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM (" + _BM25 + "SELECT query_id, doc_id, score FROM top WHERE doc_id % 4 <> 0)) WHERE rank <= 4")
def hard_negatives(spark, sf):
    hits = staged(_bm25(spark, sf), "hits")
    gold = hits.where("doc_id % 4 = 0").select("query_id", "doc_id")
    return R.hard_negatives(hits, gold).select("query_id", "doc_id", "rank")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) entity, o_orderstatus AS value, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate + INTERVAL 1 DAY * (o_orderkey % 400), o_orderkey) place FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'"""
)
def belief_history(spark, sf):
    return B.belief_history(_beliefs(spark, sf).withColumn("valid_to", F.lit(None).cast("timestamp")), _ts("1998-01-01")).select("entity", "value", "seq", "place")


@query(
    """WITH c AS (SELECT CAST(user_id AS VARCHAR) entity, arg_max(event_type, (ts, event_id)) AS value, max(ts) ts FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT entity, value, CAST(floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 86400000000.0) AS BIGINT) age_days FROM c WHERE age_days >= 1"""
)
def reverify_due(spark, sf):
    """Users' states that nobody has restated for a day."""
    v = _events(spark, sf).withColumns({"valid_to": F.lit(None).cast("timestamp"), "recorded_at": F.col("valid_from"), "source_id": F.lit("events")})
    return B.reverify(v, _ts("2024-01-20"), 1).select("entity", "value", "age_days")


@query(
    """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) entity, o_orderdate f, o_orderdate + INTERVAL 1 DAY * (250 + o_orderkey % 200) t, o_orderkey k FROM orders),
b AS (SELECT entity, arg_max(f, (f, k)) f, arg_max(t, (f, k)) t FROM p WHERE year(t) = 1998 AND date_diff('day', f, t) BETWEEN 300 AND 380 GROUP BY 1) SELECT entity, (epoch_us(f) + epoch_us(t)) // 2 AS anchor_us FROM b"""
)
def fiscal_anchors(spark, sf):
    """Orders as annual periods of 250 to 449 days; the middle of the one that ends in 1998."""
    o = _beliefs(spark, sf).withColumn("recorded_at", F.col("valid_from"))
    periods = o.withColumn("valid_to", F.timestamp_add("DAY", (250 + F.col("seq") % 200).cast("int"), F.col("valid_from")))
    return B.fiscal_anchor(periods, 1998).select("entity", F.unix_micros("anchor").alias("anchor_us"))


@query(_TL + "SELECT count(DISTINCT entity) entities, count(DISTINCT entity) keys, count(*) versions, count(previous_value) changes, CAST(1 AS BIGINT) sources FROM tl")
def store_summary(spark, sf):
    return B.store_summary(B.timeline(_events(spark, sf)).withColumn("source_id", F.lit("events")))


@query(
    """WITH d AS (SELECT concat_ws('-', l_orderkey, l_linenumber) entity, CAST(l_quantity AS INT) v FROM lineitem GROUP BY ALL), p AS (SELECT a.entity, (b.v - a.v) / CAST(b.v AS DOUBLE) > 0.02 AS apart FROM d a JOIN d b ON a.entity = b.entity AND a.v < b.v)
SELECT entity, count(*) FILTER (apart) n_pairs, count(*) FILTER (apart) n_serious FROM p GROUP BY 1"""
)
def conflict_summaries(spark, sf):
    return A.conflict_summary(B.classify_conflicts(B.conflicts(_lines(spark, sf)))).select("entity", "n_pairs", "n_serious")


@query(
    _BM25
    + """SELECT query_id, doc_id, round(score, 4) score FROM top WHERE rank <> 2 AND doc_id <> query_id
UNION ALL SELECT query_id, query_id AS doc_id, coalesce(round(max(CASE WHEN top.doc_id = query_id THEN score END), 4), 1.0) score FROM top JOIN documents d ON d.doc_id = top.query_id GROUP BY 1"""
)
def settled_evidence(spark, sf):
    """Hits without the second of each question (its version was replaced) and with the document that has the question's number."""
    hits = staged(_bm25(spark, sf), "hits")
    fact = lambda df, ids: df.select("query_id", F.col("query_id").cast("string").alias("entity"), F.lit("fact").alias("attribute"), F.array(ids).alias("evidence_ids"))
    old = fact(hits.where("rank = 2"), F.col("doc_id")).withColumn("superseded_at", _ts("2024-01-01")).drop("query_id")
    heads = fact(hits.select("query_id").distinct(), F.col("query_id"))
    out = B.settle_evidence(hits, old, heads, S.table(spark, sf, "documents"))
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(
    _ROUTED
    + """, sh AS (SELECT query_id, doc_id, round(CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(c, e)) / len(c)::DOUBLE END, 9) share FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, doc_id) rank, max(share) OVER (PARTITION BY query_id) m FROM sh)
SELECT query_id, doc_id, round(share, 6) share, rank FROM k WHERE CASE WHEN m > 0.15 THEN share > 0.15 AND rank <= 5 ELSE rank <= 2 END"""
)
def routed_evidence(spark, sf):
    r = _routed(spark, sf)
    none = F.lit(None).cast("timestamp")
    claims = r.select("query_id", F.col("query_id").alias("claim_id"), F.col("claim").alias("text"), F.lit("").alias("subject"), F.lit("").alias("attribute"), none.alias("valid_from"), none.alias("valid_to")).distinct()
    return A.route(claims, r.withColumns({"valid_from": none, "valid_to": none})).select("query_id", "doc_id", F.round("share", 6).alias("share"), "rank")


@query("SELECT lang AS query_id, round(max(n) / sum(n), 6) agreement FROM (SELECT lang, lower(source), count(*) n FROM documents GROUP BY ALL) GROUP BY 1")
def evidence_agreement(spark, sf):
    d = S.table(spark, sf, "documents")
    return A.agreement(d.select(F.col("lang").alias("query_id"), F.col("source").alias("value"))).select("query_id", F.round("agreement", 6).alias("agreement"))


@query("SELECT lang AS system, coalesce(source, 'ALL') category, count(*) n, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END), 6) accuracy, count(*) FILTER (n_chars < 1200) n_abstained FROM documents GROUP BY ROLLUP (lang, source) HAVING lang IS NOT NULL")
def category_measures(spark, sf):
    d = S.table(spark, sf, "documents")
    results = d.select(F.col("lang").alias("system"), F.col("source").alias("category"), (F.col("doc_id") % 3 == 0).alias("correct"), (F.col("n_chars") < 1200).alias("abstained"))
    return A.run_measures(results).withColumn("accuracy", F.round("accuracy", 6))


@query(
    rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, '') || ' It was noted [E' || doc_id % 5 || '].', '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') p FROM documents)
SELECT doc_id AS query_id, CAST(len(p) AS INT) n_sentences, CAST(len(list_filter(p, lambda x: regexp_matches(x, '{A.CITATION}'))) AS INT) n_cited, CAST(len(list_filter(p, lambda x: regexp_matches(x, '{A.FACTUAL}'))) AS INT) n_factual FROM s"""
)
def citation_audit(spark, sf):
    """Documents as answers, each with one cited sentence at its end."""
    d = S.table(spark, sf, "documents")
    answers = d.select(F.col("doc_id").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" It was noted [E"), (F.col("doc_id") % 5).cast("string"), F.lit("].")).alias("answer"))
    return A.citation_audit(answers).select("query_id", "n_sentences", "n_cited", "n_factual")


@query("SELECT event_id AS seq, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) recent, recent > 3 AS refused FROM events")
def rate_limited(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return D.rate_limited(e, 3, 86400).select("seq", "recent", "refused")


@query(
    """WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) d, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings), m AS (SELECT label, d, avg(x) x FROM e GROUP BY ALL)
SELECT CAST(label AS BIGINT) doc_id, CAST(d - 1 AS BIGINT) d, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) x FROM m"""
)
def pooled_vectors(spark, sf):
    """Vectors as tokens of texts (their labels): mean, then unit length."""
    e = S.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("doc_id"), "embedding")
    return R.pooled(e).select("doc_id", F.posexplode("v").alias("d", "x")).select("doc_id", F.col("d").cast("long").alias("d"), F.round("x", 5).alias("x"))


@query(
    r"""WITH f AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '(?im)^.*(last updated|generated on|page loaded|copyright \d{4}|session id|\d{1,2}:\d{2}:\d{2}|csrf|nonce=)[^\n]*$', '', 'g')), '[a-z0-9]+') w FROM documents),
g AS (SELECT doc_id, md5(array_to_string(w[i:i + k - 1], ' ')) h FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM (SELECT *, CASE WHEN len(w) < 3 THEN 1 ELSE 3 END k FROM f))),
n AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT hi, ('0x' || substr(h, 9, 8))::BIGINT lo FROM g),
v AS (SELECT doc_id, b, 2 * sum((hi >> b) & 1) > count(*) x, 2 * sum((lo >> b) & 1) > count(*) y FROM (SELECT *, unnest(range(0, 32)) b FROM n) GROUP BY ALL),
p AS (SELECT doc_id, CAST(sum(CASE WHEN x THEN CAST(pow(2, b) AS BIGINT) ELSE 0 END) AS BIGINT) hi, CAST(sum(CASE WHEN y THEN CAST(pow(2, b) AS BIGINT) ELSE 0 END) AS BIGINT) lo FROM v GROUP BY 1)
SELECT f.doc_id, CASE WHEN f.w IS NOT NULL THEN printf('%08x%08x', coalesce(hi, 0), coalesce(lo, 0)) END fingerprint FROM f LEFT JOIN p ON f.doc_id = p.doc_id"""
)
def simhash_prints(spark, sf):
    """Fingerprints of the change detector, over MD5 (its own hash, BLAKE2b, has no counterpart in SQL)."""
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", F.lower(F.lpad(F.hex(X.simhash(F.col("text"), "md5")), 16, "0")).alias("fingerprint"))


@query()
def poll_cascade(spark, sf):
    """Documents of a source as its successive polls, with the fingerprint stage; tests hold it against the streaming detector."""
    d = S.table(spark, sf, "documents")
    polls = d.select(F.col("source").alias("source_id"), F.lit(0).alias("at"), F.col("doc_id").alias("seq"), "text")
    return D.detect_batch(polls, D.NEAR_BITS).select("seq", "reason", "changed")


@query()
def token_windows(spark, sf):
    """Training windows over byte values; tests hold the windows against the texts."""
    d = S.table(spark, sf, "documents")
    ids = d.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), ""), lambda c: F.ascii(c)).alias("ids"))
    return P.token_windows(ids, 64).select("doc_id", "draw", "start", F.size("x").alias("n"))


_YEARLY = """v AS (SELECT l_suppkey k, year(l_shipdate) y, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // 100 AS BIGINT) r FROM lineitem GROUP BY ALL),
e AS (SELECT k, y, replace(s_name, '#', '-') e, r || ' USD' AS val, max(y) OVER (PARTITION BY k) latest, count(*) OVER (PARTITION BY k) n FROM v JOIN supplier ON k = s_suppkey), s AS (SELECT DISTINCT k, e, latest, n FROM e)"""


def _yearly_revenue(spark, sf):
    """Revenue of every supplier and year: versions of a store, open in the last year, and sentences as their evidence."""
    rows = S.table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.expr("sum(cast(round(l_extendedprice * 100) as long)) div 100").alias("r"))
    rows = rows.join(S.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("entity", F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))
    last = rows.groupBy("l_suppkey").agg(F.max("y").alias("latest"))
    rows = rows.join(last, "l_suppkey").withColumns({"doc_id": F.concat_ws("-", "l_suppkey", "y"), "value": F.concat(F.col("r").cast("string"), F.lit(" USD"))})
    day = lambda m, d: F.make_timestamp("y", F.lit(m), F.lit(d), F.lit(0), F.lit(0), F.lit(0))
    rows = rows.withColumns({"valid_from": day(1, 1), "valid_to": F.when(F.col("y") < F.col("latest"), day(12, 31)), "recorded_at": F.timestamp_add("YEAR", F.lit(1), day(2, 1)), "date": F.timestamp_add("YEAR", F.lit(1), day(2, 1))})
    rows = staged(rows.select("l_suppkey", "entity", "y", "value", "doc_id", "valid_from", "valid_to", "recorded_at", "date"), "yearly")
    said = F.concat("entity", F.lit(" revenue was "), "value", F.lit(" in "), F.col("y").cast("string"), F.lit("."))
    chunks = rows.select("doc_id", said.alias("text"), F.lit("sec.gov").alias("source"), "date", F.lit(1).alias("tier"), "valid_from", "valid_to", "entity")
    versions = rows.select("entity", F.lit("revenue").alias("attribute"), (F.col("l_suppkey") * 10000 + F.col("y")).alias("seq"), "value", "valid_from", "valid_to", "recorded_at", F.lit(None).cast("timestamp").alias("superseded_at"), F.lit("sec.gov").alias("source_id"), F.array("doc_id").alias("evidence_ids"), F.lit("CREATED").alias("change_kind"))
    return versions, chunks


@query(
    f"""WITH {_YEARLY}, c AS (SELECT k, e || ': revenue is ' || val || ' (from ' || y || '-01-01, sec.gov).' said, y, latest FROM e)
SELECT s.k query_id, CASE k % 4 WHEN 0 THEN (SELECT said FROM c WHERE c.k = s.k AND c.y = c.latest) WHEN 1 THEN (SELECT said FROM c WHERE c.k = s.k AND c.y = 1996)
  WHEN 2 THEN 'The record holds what was true and when; it cannot settle this kind of question.' ELSE (SELECT string_agg(e || '=' || val, '; ' ORDER BY k) FROM e WHERE e.k IN (s.k - 1, s.k) AND y = 1996) END answer,
k % 4 = 2 abstained, CASE WHEN k % 4 < 2 THEN n ELSE 0 END n_versions FROM s"""
)
def questions_answered(spark, sf):
    """A question about every supplier, all in one set: its present revenue, that of a year, a forecast, or a comparison with its neighbour."""
    from tidemark.plans.answer import Engine

    versions, chunks = _yearly_revenue(spark, sf)
    k = F.col("s_suppkey")
    name = lambda key: F.concat(F.lit("Supplier-"), F.lpad(key.cast("string"), 9, "0"))
    asked = (
        F.when(k % 4 == 0, F.concat(F.lit("What is the current revenue of "), name(k), F.lit("?")))
        .when(k % 4 == 1, F.concat(F.lit("What was "), name(k), F.lit(" revenue in 1996?")))
        .when(k % 4 == 2, F.concat(F.lit("Will "), name(k), F.lit(" revenue grow?")))
        .otherwise(F.concat(F.lit("Compare "), name(k - 1), F.lit(" and "), name(k), F.lit(" revenue in 1996")))
    )
    sold = versions.select("entity").distinct()
    questions = S.table(spark, sf, "supplier").join(sold, name(k) == F.col("entity"), "left_semi").select(k.alias("query_id"), asked.alias("question"))
    got = Engine(versions, chunks, datetime(2002, 6, 1, tzinfo=timezone.utc)).answers(questions)
    sides = F.array_join(F.transform("comparison", lambda c: F.concat(c["entity"], F.lit("="), c["value"])), "; ")
    return got.select("query_id", F.when(F.size("comparison") > 0, sides).otherwise(F.col("answer")).alias("answer"), "abstained", "n_versions")


def flagship(spark: SparkSession) -> DataFrame:
    """State of every user as of an instant."""
    return bt_as_of(spark, "/root/testdata/sf0.001")
