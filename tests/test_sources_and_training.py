"""Loading of all sources, the builder, training examples and shards, small functions that nothing else names."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import evidence as E
from tidemark.functions import temporal as T
from tidemark.functions import text as X
from tidemark.operators import corpus as P
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.plans.build import Builder
from tidemark.sources import readers as S
from tidemark.streaming import detector as D

REF = datetime(2026, 6, 1, tzinfo=timezone.utc)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.fixture()
def folder(tmp_path):
    put = lambda name, rows: (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    fact = {"entity": "Contoso Corporation", "cik": "1", "attribute": "revenue", "unit": "USD", "filed": "2023-07-27", "accn": "a", "tag": "Revenues", "source": "sec.gov"}
    put("sec_facts", [fact | {"value": 211915000000.0, "valid_from": "2022-07-01", "valid_to": "2023-06-30"}])
    tenure = {"cik": "1", "attribute": "ceo", "source": "wikidata.org", "retrieved": "2025-01-01"}
    put("ceo_tenures", [tenure | {"entity": "Contoso", "value": "Ada Park", "valid_from": "2015-01-01", "valid_to": "2020-01-01"}, tenure | {"entity": "Contoso", "value": "Lena Voss", "valid_from": "2020-01-01"}])
    put("wiki_revisions", [{"entity": "Contoso Corporation", "revid": 1, "timestamp": "2016-01-01", "facts": {"ceo": "Someone Else"}}, {"entity": "Fabrikam", "revid": 2, "timestamp": "2016-01-01", "facts": {"ceo": "Kim Lee"}}])
    put("feeds", [{"source": "reuters.com", "title": "Contoso opens an office", "summary": "Contoso opened an office in Lyon this week.", "published": "Mon, 06 Jan 2025 10:00:00 GMT", "url": "http://reuters.com/1"}])
    return str(tmp_path)


def test_sources_load_in_order_of_precedence(spark, folder):
    facts, documents = S.load_all(spark, folder)
    got = {(r.entity, r.attribute, r.value, r.source_id) for r in facts.collect()}
    assert got == {
        ("Contoso Corporation", "revenue", "211915000000.00 USD", "sec.gov"), ("Contoso Corporation", "ceo", "Ada Park", "wikidata.org"),
        ("Contoso Corporation", "ceo", "Lena Voss", "wikidata.org"), ("Fabrikam", "ceo", "Kim Lee", "en.wikipedia.org"),
    }
    assert documents.count() == 1 and S.load_all(spark, folder + "/none")[0].count() == 0


def test_builder_answers_from_all_sources(spark, folder):
    b = Builder(spark).load(folder).add_source("reuters.com", 1).add_aliases(spark.createDataFrame([("CTS", "Contoso Corporation")], "alias string, entity string"))
    texts = [("d1", "Lena Voss is chief executive officer of Contoso Corporation.", "reuters.com")]
    b.add_documents(spark.createDataFrame([("d1", "old text", "x.com")], "doc_id string, text string, source string")).add_documents(spark.createDataFrame(texts, "doc_id string, text string, source string"))
    engine = b.build(REF)
    engine.versions = engine.versions.coalesce(1).cache()
    assert {(r.doc_id, r.tier) for r in engine.chunks.where("source = 'reuters.com'").collect()} >= {("d1#0", 1)} and engine.chunks.where("text = 'old text'").count() == 0
    assert "Lena Voss" in engine.answer("Who is the current CEO of CTS?").answer


def test_messages_round_trip(spark):
    payload = F.struct(F.lit("s").alias("source_id"), F.lit("a text").alias("text"), F.lit(2).alias("tier"))
    got = one(spark, S.envelope(S.message(F.lit("raw"), F.lit("k"), F.lit("2025-01-01"), payload)))[0]
    assert (got.topic, got.key, got.payload.text, got.payload.tier) == ("raw", "k", "a text", 2)
    assert "kafka.sasl.mechanism" in S.kafka_options("h:1", "t", "u", "p") and "kafka.security.protocol" not in S.kafka_options("h:1", "t")


def test_dates_are_no_more_precise_than_their_source(spark):
    at = F.lit("2020-03-05").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert one(spark, T.shown_date(at, F.lit("year")), T.shown_date(at, F.lit("month")), T.shown_date(at), T.shown_date(none), T.shown_end(none)) == ("2020", "March 2020", "2020-03-05", "unknown", "present")
    assert one(spark, T.halflife(F.lit("CEO")), T.halflife(F.lit("other")), D.volatility(F.lit(4), F.lit(1)), D.volatility(F.lit(0), F.lit(0))) == (365.0, 240.0, 0.25, 0.0)


def test_tiers_can_be_overridden(spark):
    assert one(spark, E.tier(F.lit("Blog.example.com")), E.tier(F.lit("Blog.example.com"), overrides={"blog.example.com": 1}), E.authority(F.lit("x.org"), overrides={"x.org": 4})) == (3, 1, 0.2)


def test_examples_have_ids_mask_and_padding(spark):
    specials = ("<|bos|>", "<|eos|>", "<|pad|>", "<|user|>", "<|assistant|>")
    bpe = P.Bpe([], specials)
    rows = spark.createDataFrame([(1, 1, "assistant", "yo"), (1, 0, "user", "hi!"), (2, 0, "user", "x" * 30)], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in P.training_examples(rows, bpe, 12).collect()}
    s = bpe.special_ids
    want = [s["<|bos|>"], s["<|user|>"], *b"hi!", s["<|assistant|>"], *b"yo", s["<|eos|>"]]
    assert got[1].ids == want + [s["<|pad|>"]] * 3 and got[1].mask == [0] * 6 + [1, 1, 1] + [0] * 3 and got[1].n == 9
    assert len(got[2].ids) == 12 and got[2].n == 12 and sum(got[2].mask) == 0
    totals = P.loss_mask(rows, F.length("text")).where("conv_id = 1").first()
    assert (totals.n_tokens, totals.n_trained) == (9, 3)


def test_shards_hold_all_tokens_in_order(spark, tmp_path):
    ids = spark.range(50).select(F.col("id").alias("doc_id"), F.array_repeat(F.col("id").cast("int"), (F.col("id") % 7).cast("int")).alias("ids"))
    shards = P.write_shards(ids, str(tmp_path / "s"), 30, 4).orderBy("shard").collect()
    assert sum(r.n_docs for r in shards) == 50 and sum(r.n_tokens for r in shards) == sum(i % 7 for i in range(50)) and all(r.n_tokens <= 36 for r in shards)
    back = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    assert all(x.b < y.a for x, y in zip(back[:-1], back[1:], strict=True))


def test_chunks_by_own_count_and_as_table_function(spark):
    text = "# Head\n\nOne two three.\n\nFour five six.\n\nSeven eight nine."
    words = lambda s: len(s.split())
    got = P.chunk_text(text, 6, 0, words)
    assert [c[0] for c in got] == ["One two three.\n\nFour five six.", "Seven eight nine."] and text[got[0][1] : got[0][2]] == got[0][0] and got[0][3] == "Head"
    spark.udtf.register("chunk_table", P.ChunkTable)
    rows = spark.sql("SELECT * FROM VALUES ('a b c') t(x), LATERAL chunk_table(x, 256, 40)").collect()
    assert len(rows) == 1 and rows[0].text == "a b c"


def test_index_of_batches_scores_as_the_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue fox sits"), (3, "red red dog"), (4, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "dog")], "query_id int, text string")
    index = R.TextIndex(spark, str(tmp_path), parts=4)
    index.add(docs.where("doc_id < 3"))
    index.add(docs.where("doc_id >= 3"))
    order = ["query_id", "rank"]
    rows = lambda df: [tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").orderBy(*order).collect()]
    assert rows(index.top(asked)) == rows(R.bm25_top(docs, asked)) and len(rows(index.top(asked))) == 4


def test_graph_edges_and_nodes(spark):
    edges = spark.createDataFrame([("doc:a", "c1", "SUPPORTS"), ("doc:b", "c1", "SUPPORTS"), ("c1", "ent:acme", "ABOUT"), ("c1", "c2", "CONTRADICTS")], "src string, dst string, etype string")
    dated = spark.createDataFrame([("doc:a", "2024-02-01"), ("doc:b", "2024-01-01")], "id string, date string")
    assert [(r.claim, r.doc) for r in G.first_reported(edges, dated).collect()] == [("c1", "doc:b")]
    assert {tuple(r) for r in G.contradictions_of(edges).collect()} == {("c1", "c2"), ("c2", "c1")} and [r.claim for r in G.claims_about(edges, "Acme").collect()] == ["c1"]
    nodes = spark.createDataFrame([("a", "doc", 1), ("b", "doc", 1)], "id string, ntype string, seq int")
    assert {tuple(r) for r in G.stats(nodes, edges).collect()} == {("doc", 2), ("SUPPORTS", 2), ("ABOUT", 1), ("CONTRADICTS", 1)}
    new = spark.createDataFrame([("a", "claim", 2)], nodes.schema)
    assert {tuple(r) for r in G.upsert(nodes, new, ["id"]).select("id", "ntype").collect()} == {("a", "claim"), ("b", "doc")}
    events = spark.createDataFrame([("Acme", "ceo", "CHANGED", "c9"), ("Acme", "ceo", "CONFLICT", "c8")], "entity string, attribute string, kind string, claim string")
    claims = spark.createDataFrame([("Acme", "ceo", "c1")], "entity string, attribute string, claim string")
    added = G.apply_events(edges, events, claims).where("weight is not null")
    assert {(r.src, r.dst, r.etype) for r in added.collect()} == {("c9", "c1", "SUPERSEDES"), ("c8", "c1", "CONTRADICTS")}


def test_small_text_and_retrieval_functions(spark):
    row = one(spark, X.table_row(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))), X.contextualized(F.lit("T"), F.lit("H"), F.lit("x")), X.contextualized(F.lit(""), F.lit(""), F.lit("x")), X.label(F.lit("ceo")), X.label(F.lit("net_income")), F.length(X.stable_id(F.lit("s"), F.lit("t"))))
    assert row == ("a: 1 | b: 2", "T > H\nx", "x", "CEO", "net income", 16)
    hits = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "a", 0.9), (1, 1, "b", 0.7)], "query_id int, sub_id int, doc_id string, score double")
    assert [(r.doc_id, r.score) for r in R.best_of_subqueries(hits, 2).orderBy("rank").collect()] == [("a", 0.9), ("b", 0.7)]
    assert one(spark, R.quantized(F.array(F.lit(3.0), F.lit(-4.0))))[0] == [76, -102]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, text string")
    assert {tuple(r) for r in P.replace_document(old, spark.createDataFrame([(2, "z")], old.schema)).collect()} == {(1, "x"), (2, "z")}
    evidence = spark.createDataFrame([(1, "Who?", 2, "b.com", None, 3, "late"), (1, "Who?", 1, "a.com", "2024", 1, "early")], "query_id int, question string, n int, source string, date string, tier int, text string")
    prompt = P.evidence_prompt(evidence).first().prompt
    assert prompt.index("[E1] source=a.com date=2024 tier=1") < prompt.index("[E2] source=b.com date=unknown tier=3") < prompt.index("Question: Who?")


def test_files_come_back(spark, tmp_path):
    (tmp_path / "chat.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}))
    assert [(r.turn, r.role, r.text) for r in S.chats(spark, str(tmp_path / "chat.jsonl")).orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "yo")]
    S.save(spark.range(3), str(tmp_path / "t"))
    assert S.load(spark, str(tmp_path / "t")).count() == 3
