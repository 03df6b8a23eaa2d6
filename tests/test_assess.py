"""Routing, agreement, gaps, rewriting, audits, fingerprints and further store operators on inline rows."""

import hashlib
import random
import re
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import text as X
from tidemark.operators import assess as A
from tidemark.operators import bitemporal as B
from tidemark.operators import claims as C
from tidemark.operators import corpus as P
from tidemark.operators import retrieval as R
from tidemark.sources import readers as S
from tidemark.streaming import detector as D


def stamp(c):
    return F.col(c).cast("timestamp")


def test_route_prefers_the_same_subject_period_and_attribute(spark):
    claims = spark.createDataFrame([(1, "c", "Acme revenue was 5 million", "Acme", "revenue", "2020-01-01", "2020-12-31"), (1, "d", "Umbrella profit", "Umbrella", "profit", None, None)], "query_id int, claim_id string, text string, subject string, attribute string, valid_from string, valid_to string")
    rows = [
        (1, "same", "Acme revenue was 5 million", "a", "2020-01-01", "2020-12-31"),
        (1, "other year", "Acme revenue was 4 million", "a", "2018-01-01", "2018-12-31"),
        (1, "other attribute", "Acme profit was 1 million", "a", "2020-01-01", "2020-12-31"),
        (1, "other firm", "Globex revenue was 5 million", "b", "2020-01-01", "2020-12-31"),
        (2, "other question", "Acme revenue was 5 million", "a", None, None),
        (1, None, None, None, None, None),
    ]
    evidence = spark.createDataFrame(rows, "query_id int, doc_id string, text string, source string, valid_from string, valid_to string")
    times = lambda df: df.withColumns({c: stamp(c) for c in ("valid_from", "valid_to")})
    got = A.route(times(claims), times(evidence)).collect()
    assert [(r.claim_id, r.doc_id, r["rank"]) for r in got] == [("c", "same", 1)]
    loose = A.route(times(claims), times(evidence).where("doc_id in ('other year', 'other attribute')")).collect()
    assert sorted(r.doc_id for r in loose) == ["other attribute", "other year"]  # nothing fits: the whole subject pool


def test_focused_claims(spark):
    claims = spark.createDataFrame([(1, "a", i, "Acme revenue rose again", "Acme Corp", "revenue", i) for i in range(20)] + [(1, "a", 99, "Globex revenue rose", "Globex", "revenue", 99), (1, "a", 98, "revenue rose", "", "revenue", 98), (2, "b", 1, "Acme hired unicorns", "Acme", "", 1), (2, "b", 2, "Acme hired people", "Acme", "", 2)], "query_id int, doc_id string, claim_id int, text string, subject string, attribute string, start int")
    questions = spark.createDataFrame([(1, "What is Acme revenue?", "Acme", "revenue"), (2, "How many unicorns at Acme?", "Acme", "")], "query_id int, question string, entity string, attribute string")
    got = A.focused(claims, questions).orderBy("query_id", "place").collect()
    assert [r.claim_id for r in got if r.query_id == 1] == list(range(12))
    assert [r.claim_id for r in got if r.query_id == 2] == [1]


def test_agreement_and_gaps(spark):
    values = spark.createDataFrame([(1, "X"), (1, "x "), (1, "Y"), (2, None), (2, "")], "query_id int, value string")
    assert {r.query_id: round(r.agreement, 3) for r in A.agreement(values).collect()} == {1: 0.667, 2: 1.0}
    state = "n_independent int, min_sources int, intent string, n_fresh int, n_history int, n_changes int, needs_both boolean, score double"
    rows = [(0, 1, "CURRENT", 0, 0, 0, False, 0.0), (2, 2, "CURRENT", 1, 1, 0, False, 0.8), (2, 1, "CHANGE", 1, 1, 0, True, 0.9), (2, 1, "CURRENT", 1, 1, 0, False, 0.3)]
    got = A.gaps(spark.createDataFrame(rows, state)).collect()
    assert [list(r.gaps) for r in got] == [["no evidence", "independent sources", "current evidence"], [], ["prior state", "date of the change"], []]
    assert [r.sufficient for r in got] == [False, True, False, False]
    fits = spark.createDataFrame([(1, 0.9), (1, 0.1), (2, 0.1), (2, None)], "query_id int, fit double")
    assert {r.query_id: (r.n_fresh, r.n_stale, r.only_stale) for r in A.temporal_split(fits, F.col("fit")).collect()} == {1: (1, 1, False), 2: (0, 2, True)}


def test_rewrite_drops_what_has_no_support(spark):
    rows = [("a", "X holds", "SUPPORTED", ["d1", "d2", "d3", "d4"], None, None), ("b", "Y holds", "CONFLICTED", ["s1"], ["s2"], None), ("c", "Z held", "TEMPORAL_MISMATCH", None, None, "2020-01-01"), ("d", "W", "REFUTED", None, ["s"], None), ("e", "V", "INSUFFICIENT", None, None, None)]
    out = {r.claim_id: r.sentence for r in A.rewrite(spark.createDataFrame(rows, "claim_id string, text string, verdict string, backing array<string>, refuting array<string>, valid_to string")).collect()}
    assert sorted(out) == ["a", "b", "c"] and out["a"] == "X holds [d1], [d2], [d3]" and "s1" in out["b"] and "s2" in out["b"] and "2020-01-01" in out["c"]


def test_answers_are_split_and_audited(spark):
    answers = spark.createDataFrame([(1, "Acme revenue was 5 million [E1]. It is growing. Fine words.", "Acme"), (2, None, None), (3, "", "")], "query_id long, answer string, subject string")
    claims = A.answer_claims(answers).collect()
    assert {r.query_id for r in claims} == {1} and not any("[E" in r.text for r in claims)
    got = {r.query_id: (r.n_sentences, r.n_cited, r.n_factual, r.n_uncited_factual, r.citation_density) for r in A.citation_audit(answers).collect()}
    assert got == {1: (3, 1, 2, 1, 0.5), 2: (0, 0, 0, 0, 0.0), 3: (0, 0, 0, 0, 0.0)}


def test_answer_measures(spark):
    claims = F.expr("array(named_struct('verdict', 'SUPPORTED', 'citations', array('a')), named_struct('verdict', 'REFUTED', 'citations', array('b')), named_struct('verdict', 'INSUFFICIENT', 'citations', cast(array() as array<string>)))")
    row = spark.range(1).select(M.citation_accuracy(claims).alias("c"), M.unsupported_rate(claims).alias("u"), M.conflict_found(F.lit(0), F.lit("CONFLICTED"), F.lit(True)).alias("f")).first()
    assert (row.c, round(row.u, 3), row.f) == (0.5, 0.667, True)
    results = spark.createDataFrame([("s", "A", True, False), ("s", "A", False, False), ("s", "B", True, True)], "system string, category string, correct boolean, abstained boolean")
    assert {r.category: (r.n, round(r.accuracy, 3), r.n_abstained) for r in A.run_measures(results).collect()} == {"A": (2, 0.5, 0), "B": (1, 1.0, 1), "ALL": (3, 0.667, 1)}


def versions(spark):
    rows = [("Acme", "revenue", 1, "168", "2020-07-01", "2021-06-30", "2021-08-01", None, "10-K", ["d1"]), ("Acme", "revenue", 2, "198", "2021-07-01", "2022-06-30", "2022-08-01", None, "10-K", ["d2"]), ("Acme", "revenue", 3, "160", "2020-07-01", "2021-06-30", "2021-07-15", "2021-08-01", "10-K", ["d0", "d1"])]
    df = spark.createDataFrame(rows, "entity string, attribute string, seq long, value string, valid_from string, valid_to string, recorded_at string, superseded_at string, source_id string, evidence_ids array<string>")
    return df.withColumns({c: stamp(c) for c in ("valid_from", "valid_to", "recorded_at", "superseded_at")})


def test_store_views(spark):
    v = versions(spark)
    assert [r.seq for r in B.history(v).orderBy("place").collect()] == [1, 2] and B.history(v, superseded=True).count() == 3
    t = F.lit("2021-01-01").cast("timestamp")
    assert [r.value for r in B.belief_history(v, t).orderBy("place").collect()] == ["160", "168"]
    year = B.fiscal_anchor(v, 2021).first()
    assert year.valid_from == datetime(2020, 7, 1) and year.anchor.date() == datetime(2020, 12, 30).date()
    assert B.fiscal_anchor(v, 2019).count() == 0
    open_end = v.withColumn("valid_to", F.when(F.col("seq") == 1, F.col("valid_to")))
    late = F.lit("2023-01-01").cast("timestamp")
    assert [(r.value, r.source_id, r.age_days) for r in B.reverify(open_end, late).collect()] == [("198", "10-K", 153)]
    assert B.reverify(open_end, late, 200).count() == 0
    assert [r.entity for r in B.entities(v).collect()] == ["Acme"]


def test_superseded_documents_go_and_heads_come_in(spark):
    hits = spark.createDataFrame([(1, "d0", 3.0), (1, "d1", 2.0), (1, "x", 1.0)], "query_id int, doc_id string, score double")
    heads = spark.createDataFrame([(1, "Acme", "revenue", ["d1", "d9"])], "query_id int, entity string, attribute string, evidence_ids array<string>")
    docs = spark.createDataFrame([("d0",), ("d1",), ("d9",), ("x",)], "doc_id string")
    got = {r.doc_id: r.score for r in B.settle_evidence(hits, versions(spark), heads, docs).collect()}
    assert got == {"d1": 2.0, "x": 1.0, "d9": 1.0}


def brute_simhash(text, width=3):
    words = re.findall("[a-z0-9]+", text.lower())
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or words
    hashes = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams]
    return sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(n)) for n in (1, 2, 3, 4, 50, 3000)] + ["", "  !!", "é ü"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, text string").withColumn("h", X.simhash(F.col("text")))
    got = {r.id: r.h for r in df.collect()}
    assert got.pop(99) is None
    assert [h & (1 << 64) - 1 for h in got.values()] == [brute_simhash(t) for t in texts]
    assert spark.range(1).select(X.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))).first()[0] == 64


def test_stream_stages_equal_batch_twin(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(400))
    polls = [(1, long, "", ""), (2, long + " end", "", ""), (3, long + " end", "", ""), (4, "all new words here", "", "m1"), (5, "whatever it says", "", "m1"), (6, "something else again", "t", ""), (7, "and yet another text", "t", "")]
    schema = "source_id string, at timestamp, seq long, text string, etag string, last_modified string, claims map<string,string>"
    df = spark.createDataFrame([("s", datetime(2024, 1, n), n, t, e, m, None) for n, t, e, m in polls], schema)
    df.write.parquet(str(tmp_path / "in"))
    run = D.detect(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [r.reason for r in spark.table("stages").orderBy("seq").collect()]
    assert got == ["first-seen", "cosmetic-edit", "identical-content", "content-change", "last-modified-match", "content-change", "etag-match"]
    twin = [r.reason for r in D.detect_batch(df, D.NEAR_BITS).orderBy("seq").collect()]
    assert twin[:4] == got[:4]


def test_rate_limit(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 20)] + [("a", datetime(2024, 1, 1, 0, 2)), ("b", datetime(2024, 1, 1))]
    got = D.rate_limited(spark.createDataFrame(rows, "client string, at timestamp"), 2).orderBy("client", "at").collect()
    assert [(r.recent, r.refused) for r in got] == [(1, False), (2, False), (3, True), (1, False), (1, False)]


def test_token_windows_shift_by_one(spark):
    ids = spark.createDataFrame([(1, list(range(50))), (2, list(range(9))), (3, None), (4, list(range(11)))], "doc_id int, ids array<int>")
    got = P.token_windows(ids, 10, per_doc=3).collect()
    assert {r.doc_id for r in got} == {1, 4} and len(got) == 6
    assert all(len(r.x) == len(r.y) == 10 and r.y == [v + 1 for v in r.x] and r.x[0] == r.start for r in got)


def test_pooled_vectors(spark):
    rows = [(1, [1.0, 0.0], True), (1, [0.0, 3.0], True), (1, [9.0, 9.0], False)]
    df = spark.createDataFrame(rows, "doc_id int, embedding array<double>, keep boolean")
    assert np.allclose(R.pooled(df, F.col("keep")).first().v, np.array([0.5, 1.5]) / np.hypot(0.5, 1.5))


def test_wiki_markup_and_benchmark_counts(spark):
    box = "{{Infobox company\n| key_people = {{ubl|[[Tim Cook]] {{small|(CEO)}}|Jane Roe}}<ref>x</ref>\n| revenue = {{increase}} {{US$|391 billion}}\n| empty =\n}}"
    row = spark.range(1).select(*[S.wiki_text(X.infobox_field(F.lit(box), *n)).alias(n[-1]) for n in (("ceo", "key_people"), ("revenue",), ("absent",))]).first()
    assert "Tim Cook (CEO)" in row.key_people and "Jane Roe" in row.key_people and "US$ 391 billion" in row.revenue and row.absent == ""
    items = spark.createDataFrame([("A",), ("A",), ("B",)], "category string")
    assert {r.category: r.n for r in S.benchmark_stats(items).collect()} == {"A": 2, "B": 1, "ALL": 3}


def test_conflict_summary(spark):
    rows = [("Acme", "n", i, v, s, None, None) for i, v, s in ((1, "4.83", "a"), (2, "6.12", "b"), (3, "6.13", "c"))]
    v = spark.createDataFrame(rows, "entity string, attribute string, seq long, value string, source_id string, valid_from timestamp, valid_to timestamp")
    r = A.conflict_summary(B.classify_conflicts(B.conflicts(v))).first()
    assert (r.n_pairs, r.n_serious) == (2, 2) and r.summary == "4.83 / 6.12; 4.83 / 6.13"


def test_answers_read_aloud():
    from tidemark.plans.answer import Answer

    a = Answer("q", "It is 5 [E1].", False, support_level="HIGH", citations=[{"source": "a"}, {"source": "b"}])
    assert a.to_speech() == "It is 5. 2 independent sources support this." and '"answer"' in a.to_json()


def test_usable_claims_have_a_last_state(spark):
    docs = spark.createDataFrame([("a", "Acme revenue was 5 million. Acme revenue was 6 million.")], "doc_id string, text string")
    assert [r.value for r in C.state_of(C.extract(docs)).collect()] == ["6e+06"]
