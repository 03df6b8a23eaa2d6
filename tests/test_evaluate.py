"""The benchmark harness on a small store."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.plans import evaluate as V

ITEM = "qid string, question string, category string, expected_answer array<string>, expected_outdated array<string>, should_abstain boolean, has_conflict boolean"


def test_ladder_answers_and_measures(spark):
    stamp = {c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to", "recorded_at", "superseded_at")}
    facts = [("Acme", "revenue", 1, "5 million", "2024-01-01", None, "2024-02-01", None, "sec.gov", "CREATED", None)]
    versions = spark.createDataFrame(facts, "entity string, attribute string, seq long, value string, valid_from string, valid_to string, recorded_at string, superseded_at string, source_id string, change_kind string, previous_value string").withColumns(stamp)
    texts = [("d1", "Acme revenue was 5 million.", "sec.gov", "2024-02-01", 1, "2024-01-01", None, "Acme"), ("d2", "Globex hired many people.", "x.com", "2020-02-01", 4, "2020-01-01", "2020-12-31", "Globex")]
    chunks = spark.createDataFrame(texts, "doc_id string, text string, source string, date string, tier int, valid_from string, valid_to string, entity string").withColumns({c: F.col(c).cast("timestamp") for c in ("date", "valid_from", "valid_to")})
    items = spark.createDataFrame([("q1", "What is the current revenue of Acme?", "CURRENT", ["5 million"], [], False, False), ("q2", "Will Acme revenue grow?", "INSUFFICIENT", [], None, True, False)], ITEM)
    systems = V.ladder(versions, chunks, datetime(2024, 6, 1, tzinfo=timezone.utc), max_iterations=1)
    assert list(systems) == ["lexical", "dense", "hybrid", "temporal", "full"]
    got = {(r.system, r.category): r for r in V.measures(V.answers({"full": systems["full"], "lexical": systems["lexical"]}, items)).collect()}
    assert got["full", "ALL"].accuracy == 1.0 and got["full", "ALL"].n == 2 and got["full", "INSUFFICIENT"].n_abstained == 1
    assert got["lexical", "INSUFFICIENT"].accuracy == 1.0 and got["full", "ALL"].temporal_accuracy == 1.0


def test_correct_by_kind(spark):
    schema = V.ANSWERS
    rows = [
        ("s", "1", "CURRENT", "It is 5 million.", False, "HIGH", 0, 1.0, [], ["5 Million"], [], False, False),
        ("s", "2", "CHANGE", "First X, then Y.", False, "HIGH", 0, 1.0, [], ["X", "Z"], [], False, False),
        ("s", "3", "OUTDATED_SOURCE", "X, last verified 2020", False, "LOW", 0, 1.0, [], ["X"], [], False, False),
        ("s", "4", "OUTDATED_SOURCE", "X", False, "LOW", 0, 1.0, [], ["X"], [], False, False),
        ("s", "5", "CONFLICT", "X or Y", False, "CONFLICTED", 0, 1.0, [], [], [], False, True),
        ("s", "6", "INSUFFICIENT", "X", False, "LOW", 0, 1.0, [], [], [], True, False),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("c", V.correct())
    assert [r.c for r in df.orderBy("qid").collect()] == [True, False, True, False, True, False]
