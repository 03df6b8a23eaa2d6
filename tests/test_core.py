"""Behaviour of single operators on inline rows."""

import random
import time
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import evidence as E
from tidemark.functions import metrics as M
from tidemark.functions import temporal as T
from tidemark.functions import text as X
from tidemark.operators import bitemporal as B
from tidemark.operators import claims as C
from tidemark.operators import corpus as P
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.plans import planner
from tidemark.sources import readers as S
from tidemark.streaming import detector as D

REF = datetime(2026, 6, 1, tzinfo=timezone.utc)


def ts(t):
    return F.lit(t).cast("timestamp")


def facts(spark, rows):
    """(value, valid_from, valid_to, recorded_at, source)"""
    data = [("Acme", "ceo", i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "entity string, attribute string, seq long, value string, f string, t string, r string, source_id string")
    return df.withColumns({"valid_from": F.col("f").cast("timestamp"), "valid_to": F.col("t").cast("timestamp"), "recorded_at": F.col("r").cast("timestamp")}).drop("f", "t", "r")


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_change_keeps_both_states(spark):
    v = B.assert_facts(facts(spark, [("X", "2024-01-01", None, "2024-01-02", "a"), ("Y", "2026-01-01", None, "2026-01-02", "b")]))
    assert [r.value for r in B.as_of(v, ts("2025-01-01")).collect()] == ["X"]
    assert [r.value for r in B.as_of(v, ts("2026-06-01")).collect()] == ["Y"]
    assert [r.value for r in B.outdated(v, ts("2026-06-01")).collect()] == ["X"]
    assert [r.value for r in B.changes_between(v, ts("2025-01-01"), ts("2027-01-01")).collect()] == ["Y"]


def test_correction_keeps_what_was_believed(spark):
    period = ("2007-09-30", "2008-09-27")
    v = B.assert_facts(facts(spark, [("4.83", *period, "2009-10-27", "sec"), ("6.12", *period, "2010-01-25", "sec")]))
    assert {r.change_kind for r in v.collect()} == {"CREATED", "CORRECTED"}
    at = ts("2008-01-01")
    assert [r.value for r in B.as_of(v, at, ts("2009-12-01")).collect()] == ["4.83"]
    assert [r.value for r in B.as_of(v, at, ts("2010-02-01")).collect()] == ["6.12"]
    assert B.as_of(v, at, ts("2009-01-01")).count() == 0 and B.conflicts(v).count() == 0


def test_dispute_and_reaffirmation(spark):
    rows = [("1.0", "2020-01-01", None, "2020-01-02", "a.gov"), ("1.0", "2020-01-01", None, "2020-01-03", "b.com"), ("5.0", "2020-01-01", None, "2020-01-04", "reddit.com/r")]
    v = B.assert_facts(facts(spark, rows))
    got = {r.value: r for r in v.collect()}
    assert got["5.0"].change_kind == "CONFLICT" and got["1.0"].confidence == pytest.approx(0.6)
    pair = B.classify_conflicts(B.conflicts(v)).collect()
    assert [(p.conflict_type, p.severity, p.preferred) for p in pair] == [("FACTUAL", 0.6, "a")]


def test_corrections_by_hand(spark):
    v = B.assert_facts(facts(spark, [("X", "2024-01-01", None, "2024-01-02", "a")]))
    fix = spark.createDataFrame([("Acme", "ceo", 0, "Z", "c", 9)], "entity string, attribute string, seq long, new_value string, source_id string, new_seq long").withColumn("recorded_at", ts("2024-03-01"))
    after = B.correct(v, fix)
    assert [r.value for r in B.as_of(after, ts("2025-01-01")).collect()] == ["Z"] and [r.value for r in B.as_of(after, ts("2025-01-01"), ts("2024-02-01")).collect()] == ["X"]


def test_bitemporal_mode_remembers_the_open_interval(spark):
    rows = [("X", "2024-01-01", None, "2024-01-02", "a"), ("Y", "2026-01-01", None, "2026-01-02", "b")]
    v = B.assert_facts(facts(spark, rows), "bitemporal")
    assert [r.value for r in B.as_of(v, ts("2026-06-01"), ts("2025-01-01")).collect()] == ["X"]
    assert [r.value for r in B.as_of(v, ts("2026-06-01"), ts("2026-02-01")).collect()] == ["Y"]


def test_fold_equals_window_in_order(spark):
    rng = random.Random(2)
    data = [(str(k), "a", i, rng.choice("xyz"), f"2024-01-{i + 1:02d}", "s") for k in range(30) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame(data, "entity string, attribute string, seq long, value string, d string, source_id string").withColumn("valid_from", F.col("d").cast("timestamp")).withColumn("recorded_at", F.col("valid_from"))
    shown = lambda v: sorted(map(tuple, v.select("entity", "seq", "value", "previous_value", F.col("valid_from").cast("string"), F.col("valid_to").cast("string")).collect()), key=repr)
    assert shown(B.assert_facts(df)) == shown(B.timeline(df))


def test_tenures_are_cut_and_merged(spark):
    rows = [("Co", "Ann", "2000-01-01", "2010-06-30"), ("Co", "Bob", "2010-06-01", "2015-01-01"), ("Co", "Cy", "2012-01-01", "2015-01-01")]
    df = spark.createDataFrame(rows, "entity string, value string, f string, t string").select("entity", "value", F.col("f").cast("timestamp").alias("valid_from"), F.col("t").cast("timestamp").alias("valid_to"))
    got = [r.value for r in B.tenure_segments(df).orderBy("valid_from").collect()]
    assert got == ["Ann", "Bob", "Bob and Cy (co-CEOs)"]


def test_canonical_names(spark):
    names = spark.createDataFrame([("apple",), ("Apple Inc.",), ("Nobody",)], "name string")
    known = spark.createDataFrame([("Apple Inc",), ("Apple Hospitality",)], "entity string")
    assert {r.name: r.entity for r in B.canonical(names, known).collect()} == {"apple": "Apple Inc", "Apple Inc.": "Apple Inc", "Nobody": "Nobody"}


def test_times_are_parsed(spark):
    shown = lambda t: T.parse_time(F.lit(t)).cast("string")
    got = one(spark, *map(shown, ["2024-02-03", "03/04/2026", "March 2021", "5 May 2020", "in about 1999 or so", "none", "2024-01-01T10:00:00Z"]))
    assert got == ("2024-02-03 00:00:00", "2026-04-03 00:00:00", "2021-03-01 00:00:00", "2020-05-05 00:00:00", "1999-01-01 00:00:00", None, "2024-01-01 10:00:00")


def test_amounts_round_as_python(spark):
    df = spark.createDataFrame([(211_915_000_000.0, "USD"), (12.0, "USD"), (1500.0, "shares")], "v double, u string")
    assert [r.x for r in df.select(X.human_amount("v", "u").alias("x")).collect()] == ["211.91 billion USD", "12 USD", "1,500 shares"]


def test_text_functions(spark):
    assert one(spark, X.norm_value(F.lit(" 6,119 Million  USD ")), X.wiki_value(F.lit("ceo"), F.lit("[[Tim Cook|Cook]] {{ubl")), X.html_text(F.lit("<p>a &amp; b</p><script>x</script>"))) == ("6119 million usd", "Cook", "a & b")
    spans = one(spark, X.sentences(F.lit('One ends. "Two" starts!  Three')))[0]
    assert [(s.sentence, s.start) for s in spans] == [("One ends.", 0), ('"Two" starts!', 10), ("Three", 25)]
    a, b, c = one(spark, *[X.content_digest(F.lit(t)) for t in ("Base text", "base  text\nLast updated 12:31:02", "base text 2")])
    assert a == b and a != c
    df = spark.createDataFrame([("ﬁle\x00  a\n\n\n\nb ",)], "t string")
    assert df.select(X.clean_text("t").alias("x")).first().x == "file a\n\nb"


def test_claim_fields(spark):
    n = lambda t: E.number(F.lit(t))
    assert one(spark, n("$1,400M"), n("1.4 billion"), n("none"), n("12%")) == (1.4e9, 1.4e9, None, 12.0)
    assert one(spark, E.attribute(F.lit("in October")), E.attribute(F.lit("in October"), "reference"), E.attribute(F.lit("Net income rose"))) == ("", "cto", "net_income")
    df = spark.createDataFrame([("d", "Acme Corp named Tim Cook chief executive since January 2020. It may open 15 offices; revenue was $1.4 billion.")], "doc_id string, text string")
    got = {r.attribute: r for r in C.extract(df).collect()}
    assert got["ceo"].value == "Tim Cook" and got["ceo"].valid_from == "January 2020" and got["revenue"].value == "1.4e+09$" and got[""].hedged


def claim(spark, text, attribute="", value=""):
    df = spark.createDataFrame([("c", text, attribute, value)], "claim_id string, text string, attribute string, value string")
    return df.withColumns({"numeric": E.number(F.col("text")), "checkable": E.checkable(F.col("text"))})


def verdict(spark, c, *texts):
    e = spark.createDataFrame([("c", f"d{i}", f"s{i}", t) for i, t in enumerate(texts)], "claim_id string, doc_id string, source string, text string").withColumn("valid_to", F.lit(None).cast("timestamp"))
    return C.verify(c, e).first().verdict


def test_verdicts(spark):
    c = claim(spark, "Acme operates 15 offices")
    assert verdict(spark, c, "Acme operates 15 offices in Europe") == "SUPPORTED"
    assert verdict(spark, c, "Acme operates 12 offices") == "REFUTED"
    assert verdict(spark, c, "Acme operates 15 offices", "Acme operates 12 offices") == "CONFLICTED"
    assert verdict(spark, c, "Something else") == "INSUFFICIENT"
    p = claim(spark, "Apple named Tim Cook chief executive", "ceo", "Tim Cook")
    assert verdict(spark, p, "Apple named Steve Jobs chief executive") == "REFUTED"
    assert verdict(spark, p, "Apple named Tim Cook chief executive") == "SUPPORTED"


def test_stale_evidence(spark):
    c = claim(spark, "Acme operates 15 offices")
    e = spark.createDataFrame([("c", "d", "s", "Acme operates 15 offices")], "claim_id string, doc_id string, source string, text string").withColumn("valid_to", ts("2020-01-01"))
    v = C.verify(c, e, ts("2024-01-01"))
    assert v.first().verdict == "TEMPORAL_MISMATCH" and C.verdict_measures(v).first().stale_rate == 1.0


def test_compared_claims(spark):
    rows = [("Acme", "revenue", "1.40B", 1.4e9, "about 1.4 billion", "Acme", "revenue", "1.43B", 1.43e9, "1.43 billion"), ("Acme", "revenue", "1.4", 1.4, "x", "Bolt", "revenue", "9", 9.0, "y"), ("Acme", "price", "10", 10.0, "price 10", "Acme", "price", "20", 20.0, "price 20")]
    names = ", ".join(f"{c}_{s} {'double' if c == 'numeric' else 'string'}" for s in "ab" for c in ("subject", "attribute", "value", "numeric", "text"))
    assert [r.conflict_type for r in C.compare(spark.createDataFrame(rows, names)).collect()] == ["GRANULARITY", "NONE", "FACTUAL"]


def test_evidence_factors(spark):
    i = lambda n: F.round(E.independence(F.lit(n)), 3)
    assert one(spark, i(0), i(1), i(2), i(3), i(5)) == (0.0, 0.342, 0.626, 0.885, 0.968)
    assert one(spark, E.tier(F.lit("https://www.sec.gov"), "government"), E.tier(F.lit("reddit.com"), "corporate"), E.tier(F.lit("https://reddit.com/r"), "corporate")) == (1, 3, 4)


def test_bm25_ranks_the_match_first(spark):
    docs = spark.createDataFrame([("d1", "Acme names new chief executive"), ("d2", "Weather is mild"), ("d3", "Bolt opens offices for executive staff")], "doc_id string, text string")
    top = R.bm25_top(docs, spark.createDataFrame([(1, "who is the chief executive of Acme")], "query_id int, text string"), 3).orderBy("rank").collect()
    assert top[0].doc_id == "d1" and len(top) == 2


def test_ann_variants_recall(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {(r.query_id, r.vec_id) for r in R.vector_top(v, q, 10).collect()}
    coded = {(r.query_id, r.vec_id) for r in R.vector_top(v, q, 10, code=True).collect()}
    near = {(r.query_id, r.vec_id) for r in R.ivf_top(v, q, 10).collect()}
    assert len(exact & coded) >= 95 and len(exact & near) >= 90


def test_near_duplicates_by_bands(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 50)) for _ in range(n))
    base = words(200)
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir("/tmp/tidemark-tests")
    docs = spark.createDataFrame([(1, base), (2, base + " x"), (3, words(200)), (4, None), (5, base)], "doc_id long, text string")
    assert {r.doc_id: r.keeper for r in P.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def test_near_duplicates_along_a_chain(spark, monkeypatch):
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir("/tmp/tidemark-tests")
    docs = spark.createDataFrame([(i,) for i in range(70)], "doc_id long")
    monkeypatch.setattr(P, "minhash_bands", lambda d: d.selectExpr("doc_id", "0 band", "explode(array(doc_id div 2, 1000 + (doc_id + 1) div 2)) bucket"))
    assert {r.keeper for r in P.near_duplicates(docs).collect()} == {0}


def test_chunks_cover_their_texts(spark):
    text = "# Head\n\n" + "\n\n".join(f"Sentence {i} is here. Another one follows it." * 3 for i in range(30))
    got = P.chunk_text(text, 64, 10)
    assert len(got) > 5 and all(len(c[0]) // 4 <= 64 + 40 for c in got) and all(c[3] == "Head" for c in got)
    assert all(text[c[1] :].startswith(c[0][:20]) for c in got)
    assert P.chunk_text("") == []


def test_bpe_round_trip(spark):
    docs = spark.createDataFrame([(1, "low lower lowest néw 日本 \n low low")], "doc_id long, text string")
    bpe = P.Bpe.train(P.word_counts(docs), 270, 2, specials=("<|bos|>",))
    for t in ("low lowest", "日本 néw", "", "zq\t\n  x"):
        assert bpe.decode(bpe.encode(t)) == t
    assert len(bpe.encode(" low")) < 4 and bpe.decode([bpe.special_ids["<|bos|>"]]) == "<|bos|>"


def test_roots_of_a_depth_and_of_whole_chains(spark):
    chain = [(f"n{i:02d}", f"n{i - 1:02d}", "DERIVED_FROM") for i in range(1, 21)]
    circle = [("x", "z", "DERIVED_FROM"), ("z", "y", "DERIVED_FROM"), ("y", "x", "DERIVED_FROM"), ("tail", "z", "DERIVED_FROM"), ("a", "tail", "DERIVED_FROM")]
    edges = spark.createDataFrame(chain + circle, "src string, dst string, etype string")
    up = {s: d for s, d, _ in chain + circle}
    for depth in (0, 1, 5, 8):
        want = {}
        for node in {*up, *up.values()}:
            end = node
            for _ in range(depth):
                end = up.get(end, end)
            want[node] = end
        assert {r.id: r.root for r in G.roots(edges, depth=depth).collect()} == want, depth
    whole = {r.id: r.root for r in G.roots(edges, depth=None).collect()}
    assert {whole[f"n{i:02d}"] for i in range(21)} == {"n00"} and {whole[c] for c in ("x", "y", "z", "tail", "a")} == {"x"}


def test_origins_follow_chains_of_any_length(spark):
    derived = [(f"d{i:02d}", f"d{i - 1:02d}", "DERIVED_FROM") for i in range(1, 13)]
    backs = [("d00", "c", "SUPPORTS"), ("d12", "c", "SUPPORTS")]
    assert G.independent_sources(spark.createDataFrame(derived + backs, "src string, dst string, etype string")).first().n_independent == 1


def test_graph_roots_and_independence(spark):
    edges = spark.createDataFrame([("b", "a", "DERIVED_FROM"), ("c", "b", "DERIVED_FROM"), ("b", "k", "SUPPORTS"), ("c", "k", "SUPPORTS"), ("d", "k", "SUPPORTS"), ("b", "s1", "PUBLISHED_BY"), ("c", "s2", "PUBLISHED_BY"), ("d", "s3", "PUBLISHED_BY")], "src string, dst string, etype string")
    assert {r.id: r.root for r in G.roots(edges).collect() if r.id in "abcd"} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert G.independent_sources(edges).first().n_independent == 2 and G.independent_sources(edges, "reference").first().n_independent == 3
    assert len(G.provenance(edges).first().path) == 3


def test_planner(spark):
    asked = {
        "What is the current revenue of Helios Energy?": ("Helios Energy", "revenue", "CURRENT_STATE", "CURRENT", False),
        "Why did revenue increase in 2021?": ("", "revenue", "CAUSAL", "HISTORICAL", True),
        "What was Microsoft revenue in 2021?": ("Microsoft", "revenue", "HISTORICAL", "HISTORICAL", True),
        "What was Microsoft revenue in March 2021?": ("Microsoft", "revenue", "HISTORICAL", "HISTORICAL", False),
        "Compare Contoso and Fabrikam revenue in 2023": ("Fabrikam", "revenue", "COMPARISON", "HISTORICAL", True),
        "When did Acme Corp change its CEO?": ("Acme Corp", "ceo", "CHANGE", "CHANGE", False),
        "is it known": ("", "", "CURRENT_STATE", "CURRENT", False),
    }
    rows = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    got = {r.question: r for r in planner.planned(rows, F.lit(REF)).collect()}
    assert {q: (r.entity, r.attribute, r.kind, r.time.intent, r.time.year_only) for q, r in got.items()} == asked
    assert got["When did Acme Corp change its CEO?"].queries[2:] == ["Acme Corp ceo appointed announced effective", "Acme Corp former previous ceo"] and got["is it known"].queries == ["is it known"]
    assert got["Compare Contoso and Fabrikam revenue in 2023"].names == ["Contoso", "Fabrikam"]
    p = planner.plan(spark, "and its revenue?", REF, ["Who is the CEO of Acme Corp?", "and before?"])
    assert p.entity == "Acme Corp" and planner.gap_query(p, "independent sources") == "Acme Corp revenue report announcement filing"
    assert planner.plan(spark, "Will Apple revenue grow in 2030?", REF).kind == "FORECAST" and planner.plan(spark, None, REF).queries == [""]


def test_time_asked(spark):
    questions = ["between 2019 and 2021", "how has it changed", "who runs it now", "revenue in 2021", "as of March 2020", "it was big", "tell me", "last 3 months", "from 2019 to now"]
    got = [r.t for r in spark.createDataFrame([(q,) for q in questions], "q string").select(planner.time_asked(F.col("q"), F.lit(REF)).alias("t")).collect()]
    assert [t.intent for t in got] == ["RANGE", "CHANGE", "CURRENT", "HISTORICAL", "AS_OF", "HISTORICAL", "CURRENT", "RANGE", "RANGE"]
    assert (got[0].start.year, got[0].end.year, got[0].end.month) == (2019, 2021, 12) and (got[7].end - got[7].start).days == 90 and got[4].anchor.month == 3 and got[8].end == got[2].anchor


def test_readers(spark, tmp_path):
    rows = '{"entity":"W","attribute":"revenue","value":523964000000,"valid_from":"2019-02-01","valid_to":"2020-01-31","filed":"2020-03-20","accn":"1","tag":"Revenues"}\n'
    rows += rows.replace("523964000000", "519926000000").replace('"Revenues"', '"RevenueFromContractWithCustomerExcludingAssessedTax"')
    (tmp_path / "f.jsonl").write_text(rows)
    assert [r.value for r in S.sec_facts(spark, str(tmp_path / "f.jsonl")).collect()] == [523964000000.0]
    xml = "<rss><item><title>A &lt;b</title><link>http://x/1</link><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate><description><![CDATA[a long enough summary of this item here]]></description></item></rss>"
    items = S.feed_items(spark.createDataFrame([("s", xml)], "source string, xml string"))
    docs = S.feed_documents(items).collect()
    assert len(docs) == 1 and docs[0].url == "http://x/1" and str(docs[0].date.date()) == "2025-01-06"
    assert one(spark, S.host_tier(F.lit("https://www.sec.gov/x")), S.host_tier(F.lit("https://blog.example"))) == (1, 3)
    good, bad = one(spark, S.envelope(F.lit('{"topic":"t","payload":{"text":"x"}}')), S.envelope(F.lit("{")))
    assert good.payload.text == "x" and (bad is None or bad.payload is None)


def test_measures(spark):
    assert one(spark, M.token_f1(F.lit("the red fox"), F.lit("red dog")), M.answer_match(F.lit("It is 6.12 billion."), F.array(F.lit("6.12 Billion")))) == (0.5, True)
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "b", 1.0), (1, "z", 1.0)], "query_id int, doc_id string, relevance double")
    r = R.ranking_measures(ranked, gold, 2).first()
    assert (r.recall, r.precision, r.mrr) == (0.5, 0.5, 0.5)


def test_stream_detector(spark, tmp_path):
    polls = [("s", "2024-01-01", 1, "base text", "", {"ceo": "X"}), ("s", "2024-01-02", 2, "base text", "", {"ceo": "X"}), ("s", "2024-01-03", 3, "base text\nLast updated 12:31:02", "", {"ceo": "X"}), ("s", "2024-01-04", 4, "new text", "", {"ceo": "Y"})]
    schema = "source_id string, at timestamp, seq long, text string, etag string, claims map<string,string>"
    df = spark.createDataFrame([(s, datetime.fromisoformat(a), n, t, e, c) for s, a, n, t, e, c in polls], schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = D.detect(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("detected").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [(r.changed, r.reason) for r in spark.table("detected").orderBy("seq").collect()]
    assert got == [(True, "first-seen"), (False, "identical-content"), (False, "identical-content"), (True, "claim-change")]
    assert [r.changed for r in D.detect_batch(df).orderBy("seq").collect()] == [True, False, False, True]


def test_stream_publishes_once_and_keeps_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"topic":"t","payload":{"text":"x"}}\nnot json\n')
    raw = spark.readStream.text(str(tmp_path / "in")).select(F.col("value").alias("raw"), S.envelope(F.col("value"))["payload"].alias("payload"))
    for _ in range(2):
        D.publish(raw, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "data")).count() == 1 and spark.read.parquet(str(tmp_path / "out" / "dead")).count() == 1


def test_merged_batches_equal_one_batch(spark):
    rng = random.Random(3)
    rows = [(str(rng.randint(0, 5)), "a", rng.choice("xy"), i) for i in range(60)]
    df = spark.createDataFrame(rows, "entity string, attribute string, value string, seq long").withColumn("valid_from", F.timestamp_seconds(F.col("seq") * 3600))
    both = D.merge_facts(df.where("seq < 30"), df.where("seq >= 30"))
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, B.timeline(df.select("entity", "attribute", "value", "valid_from", "seq")).select(both.columns).collect()), key=repr)


@pytest.mark.parametrize("keep", [1 << 18, 40, 3])
def test_bpe_counts_only_what_changes(spark, monkeypatch, keep):
    """Merges by deltas equal merges by full counts, however few pairs the driver holds."""
    monkeypatch.setattr(P.Bpe, "KEEP", keep)
    rng = random.Random(14)
    counts = {"".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 12))): rng.randint(1, 9) for _ in range(150)}
    seqs, want = [(list(w.encode()), n) for w, n in counts.items()], []
    for new in range(256, 296):
        pairs = {}
        for s, n in seqs:
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + n
        best = max(pairs, key=lambda p: (pairs[p], p))
        want.append(best)
        seqs = [(P.Bpe._joined(s, best, new), n) for s, n in seqs]
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert P.Bpe.train(words, 296).merges == want


def test_pair_index_passes_by_blocks_without_the_pair(spark):
    words = spark.createDataFrame([("abab", 3), ("abc", 2), ("zz", 5), ("zzz", 1)], "word string, n long").repartition(2)
    index = P._PairIndex(words)
    whole = {(r.a, r.b): r.n for r in index.counts().collect()}
    assert whole == {(97, 98): 8, (98, 97): 3, (98, 99): 2, (122, 122): 7}
    delta = {(r.a, r.b): r.n for r in index.merge([(97, 98)]).collect()}
    assert delta == {(97, 98): -8, (98, 97): -3, (98, 99): -2, (256, 256): 3, (256, 99): 2}
    index.settle()
    assert {(r.a, r.b): r.n for r in index.counts().collect()} == {(256, 256): 3, (256, 99): 2, (122, 122): 7}
    assert {(r.a, r.b): r.n for r in index.merge([(122, 122), (256, 256)]).collect()} == {(122, 122): -7, (256, 256): -3, (257, 122): 1}
    index.close()


def test_bpe_learns_from_all_words(spark):
    many = spark.range(200_000).selectExpr("substr(md5(cast(id AS string)), 1, 8) word", "3L n").union(spark.range(50_000).selectExpr("concat('zqzqzq', id) word", "2L n"))
    assert (ord("z"), ord("q")) in P.Bpe.train(many, 260).merges
    rng = random.Random(4)
    counts = {"".join(rng.choice("aabcd") for _ in range(rng.randint(1, 9))): rng.randint(1, 5) for _ in range(200)}
    seqs, want = [(list(w.encode()), n) for w, n in counts.items()], []
    for new in range(256, 316):
        pairs = {}
        for s, n in seqs:
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + n
        best = max(pairs, key=lambda p: (pairs[p], p), default=None)
        if best is None or pairs[best] < 2:
            break
        want.append(best)
        seqs = [(P.Bpe._joined(s, best, new), n) for s, n in seqs]
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert P.Bpe.train(words, 316).merges == want


def test_fold_takes_keys_one_after_the_other_across_batches(spark):
    from tidemark.operators.bitemporal import _folded, assertions

    facts = [(f"e{i % 3}", "a", i, str(i // 2 % 4), f"2020-01-{1 + i % 28:02d}", f"2021-01-{1 + i * 7 % 28:02d}", "s") for i in range(60)]
    df = spark.createDataFrame(facts, "entity string, attribute string, seq long, value string, valid_from string, recorded_at string, source_id string")
    table = assertions(df).orderBy("entity", "attribute", "recorded_at", "seq").toArrow()
    cut = lambda n: [tuple(r.values()) for b in _folded(table.to_batches(max_chunksize=n), True) for r in b.to_pylist()]
    assert cut(1) == cut(7) == cut(1000) and len(cut(7)) == B.assert_facts(df, "bitemporal").count()


def test_bpe_encodes_distinct_words_together(spark):
    """The ids of `encode`, which takes word after word: runs of equal tokens, nulls, empty texts and texts of several slices."""
    texts = ["aaaa aaaaa aa", None, "", "the other the thing", "  12, 34 é漢字!", "aab aba baa", " ", None, "the aaaaaaa"]
    for merges in ([(97, 97), (256, 97), (256, 256), (116, 104), (259, 101), (32, 260)], []):
        bpe = P.Bpe(merges)
        want = [None if t is None else bpe.encode(t) for t in texts]
        got = [ids for part in P._slices(pa.array(texts), 8) for ids in bpe.encode_all(part).to_pylist()]
        assert got == bpe.encode_all(pa.array(texts)).to_pylist() == want
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        assert [r.ids for r in df.select("i", bpe.column(F.col("text")).alias("ids")).orderBy("i").collect()] == want


def test_sentences_of_a_long_text(spark):
    """Work in proportion to the text: 60,000 sentences in one, with gaps of several signs, and starts in code points."""
    n = 60_000
    df = spark.createDataFrame([(" Né à Rome.\n\t" + "It grew by 5 a year!  " * n + "End", ), (None,), ("",), ("  ",)], "text string")
    began = time.monotonic()
    rows = [[tuple(s) for s in r.s] if r.s is not None else None for r in df.select(X.sentences(F.col("text")).alias("s")).collect()]
    assert time.monotonic() - began < 30
    assert rows[1:] == [None, [], []] and len(rows[0]) == n + 2
    assert rows[0][:2] == [("Né à Rome.", 1), ("It grew by 5 a year!", 13)] and rows[0][-2:] == [("It grew by 5 a year!", 13 + 22 * (n - 1)), ("End", 13 + 22 * n)]


def test_leading_words_and_units(spark):
    """The first six words whatever stands between them; a unit only where there is a number."""
    texts = ["  Acme\t Group  of\nthe  North and South Sea", "Acme", "", "   ", "a b c d e Foo Bar", "% percent $", "$ 5 bn", "7 percent"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", C.leading_subject(F.col("t")).alias("s"), E.unit(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.s for r in got] == ["Acme Group of", "Acme", "", "", "Foo", "", "", ""]
    assert [r.u for r in got] == ["", "", "", "", "", "", "$", "%"]
