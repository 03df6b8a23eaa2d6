"""A caller's models in retrieval and verdicts, and monitored sources as a data source."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import claims as C
from tidemark.operators import scoring as S
from tidemark.plans.answer import Config, Engine
from tidemark.sources.fetch import SOURCE, FetchSource, rescheduled
from tidemark.streaming.topology import Topology
from tests.test_answer import engine  # noqa: F401 (a fixture)


def wordy():
    """Loaded once in a task: longer texts are better."""
    return lambda left, right: [float(len(t)) for t in right]


def sceptic():
    return lambda left, right: [-9.0] * len(left)


def believer():
    return lambda left, right: [9.0] * len(left)


def short():
    return lambda left, right: [1.0]


def test_second_stage_reorders_a_bounded_top(spark):
    rows = [(q, d, f"question {q}", None if d == 5 else "x" * d, 100.0 - d) for q in (1, 2) for d in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, query string, text string, score double").repartition(3)
    got = S.rerank(df, wordy, k=3, depth=6).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"], r.first_score) for r in got] == [(q, d, k, 100.0 - d) for q in (1, 2) for k, d in enumerate((6, 4, 3), 1)]
    assert S.rerank(df.limit(0), wordy).collect() == []
    assert [r.doc_id for r in S.rerank(df.where("query_id = 1 and doc_id >= 5"), wordy).orderBy("rank").collect()] == [8, 7, 6, 5]
    with pytest.raises(Exception, match="1 scores for 2 pairs"):
        S.scored_pairs(df.coalesce(1), "query", "text", short, "m", at_once=2).collect()


def test_a_model_takes_part_in_verdicts(spark):
    claims = C.extract(spark.createDataFrame([("d1", "Acme opened 15 offices in Lyon."), ("d2", "Acme revenue was 5 million.")], "doc_id string, text string"))
    ids = {r.text.split()[1]: r.claim_id for r in claims.collect()}
    said = [(ids["opened"], "e1", "a.com", "Acme opened 15 offices in Lyon."), (ids["opened"], "e2", "b.com", "Nothing to see here at all."), (ids["revenue"], "e3", "c.com", "Acme revenue was 9 million.")]
    evidence = spark.createDataFrame(said, "claim_id string, doc_id string, source string, text string").withColumn("valid_to", F.lit(None).cast("timestamp"))
    verdicts = lambda **more: {r.claim_id: (r.verdict, round(r.entailment, 3)) for r in C.verify(claims, evidence, **more).collect()}
    assert verdicts()[ids["opened"]] == ("SUPPORTED", 1.0)
    doubted, believed = verdicts(nli=sceptic), verdicts(nli=believer)
    assert doubted[ids["opened"]] == ("INSUFFICIENT", 0.5) and believed[ids["opened"]] == ("SUPPORTED", 1.0)
    assert verdicts()[ids["revenue"]][0] == doubted[ids["revenue"]][0] == "REFUTED"  # figures that differ need no model


def test_models_in_the_answer_loop(spark, engine):  # noqa: F811
    from tidemark.plans.planner import plan

    question = "Who is the current CEO of Acme Industries?"
    p = plan(spark, question, engine.ref)
    longest = Engine(engine.versions, engine.chunks, engine.ref, Config(k=2, reranker=wordy))
    got = longest.retrieve(p, list(p.queries))
    texts = {r.doc_id: len(r.text) for r in engine.chunks.collect()}
    found = [r.doc_id for r in got.orderBy(F.desc("score")).collect()]
    assert found == sorted(found, key=lambda d: -texts[d]) and len(found) == 2 and {r.score for r in got.collect()} == {float(texts[d]) for d in found}
    doubting = Engine(engine.versions, engine.chunks, engine.ref, Config(max_iterations=1, nli=sceptic), engine.aliases).answer(question)
    assert doubting.claims and all(c["entailment"] < 0.51 for c in doubting.claims) and doubting.coverage == 0 and "Lena Voss" in doubting.answer


def listing(spark, tmp_path, rows):
    spark.createDataFrame(rows, SOURCE).coalesce(1).write.mode("overwrite").parquet(f"file:{tmp_path}/sources")


def test_sources_are_fetched_in_batch_and_when_due(spark, tmp_path):
    for name, text in (("a", "Acme Industries revenue was 5 million in 2023."), ("b", "Globex named Ada Park chief executive officer."), ("c", "")):
        (tmp_path / f"{name}.txt").write_text(text)
    url = lambda n: f"file://{tmp_path}/{n}.txt"
    rows = [("a", url("a"), 100, True, "Acme Industries"), ("b", url("b"), 1000, True, "Globex"), ("c", url("c"), 100, True, None), ("gone", url("zzz"), 1000, True, None), ("off", url("a"), 1, False, None)]
    listing(spark, tmp_path, rows)
    spark.dataSource.register(FetchSource)
    batch = {r.source_id: r for r in spark.read.format("fetch").option("now", "5000").load(f"file://{tmp_path}/sources").collect()}
    assert set(batch) == {"a", "b", "c", "gone"} and batch["a"].text.startswith("Acme") and batch["a"].entity == "Acme Industries"
    assert batch["c"].error == "empty-response" and "FileNotFound" in batch["gone"].error and batch["gone"].text is None

    def poll(now):
        stream = lambda: spark.readStream.format("fetch").option("now", str(now)).load(f"file://{tmp_path}/sources")
        top = Topology(spark, str(tmp_path / "top"), stream)
        for name in ("changed", "dead"):
            top.start(name).awaitTermination()
        return top

    seen = lambda top, name: sorted((r.source_id, r.seq) for r in top.table(name).collect())
    top = poll(5000)
    assert seen(top, "changed") == [("a", 5000), ("b", 5000)] and seen(top, "dead") == [("c", 5000), ("gone", 5000)]
    (tmp_path / "a.txt").write_text("Acme Industries revenue was 7 million in 2023.")
    (tmp_path / "b.txt").write_text("Globex named Lena Voss chief executive officer.")
    assert seen(poll(5050), "changed") == [("a", 5000), ("b", 5000)]  # a restart within the slots fetches nothing
    top = poll(5110)  # a is due, b is not
    assert seen(top, "changed") == [("a", 5000), ("a", 5100), ("b", 5000)] and seen(top, "dead").count(("c", 5100)) == 1
    assert ("b", 6000) in seen(poll(6010), "changed")


def test_intervals_follow_changes(spark):
    sources = spark.createDataFrame([("busy", "u", 3600, True, None), ("calm", "u", 3600, True, None), ("new", "u", 77, True, None)], SOURCE)
    seen = spark.createDataFrame([("busy", 10, 9), ("busy", 4, 4), ("calm", 10, 1)], "source_id string, polls long, changes long")
    got = {r.source_id: r.poll_seconds for r in rescheduled(sources, seen).collect()}
    assert got == {"busy": 3240, "calm": 36000, "new": 77}
