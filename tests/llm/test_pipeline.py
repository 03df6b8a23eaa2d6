"""The pipeline's stages, each on what the one before kept."""

import re

import corpus_pipeline as C
from tests.llm.test_operators import SCHEMA, base_spans, texts
from tidemark.llm import decontaminate, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {"": docs}
    for name, stage in C.STAGES:
        docs = C.staged(stage(spark, docs, SF), f"test-{name}")
        got[name] = docs
    assert all(got[n].columns == COLUMNS for n in list(got)[:-1])
    before, after = got["toxicity"], got["near_dedup"]
    kept = {r.doc_id for r in after.collect()}
    groups = simhash.near_duplicates(before, 5, 24, 2).collect()
    assert kept == {r.component_id for r in groups}
    assert decontaminate.contamination(got["decontamination"], bench).where("contaminated").count() == 0
    masked = {r.doc_id: r.text for r in got["secrets"].collect()}
    for r in got["decontamination"].collect():
        text = r.text
        for a, _, b, _ in reversed(base_spans(text)):
            assert text[a:b] not in masked[r.doc_id] or re.fullmatch(r"\W*", text[a:b])
        if "[SECRET]" not in masked[r.doc_id]:
            assert masked[r.doc_id] == text
    last = got["tokens"]
    assert last.count() == got["secrets"].count() and last.where("not decoded_ok").count() == 0 and "ids" in last.columns


def test_stages_take_awkward_rows(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, 1) for i, t in texts()]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in C.STAGES:
        docs = C.staged(stage(spark, docs, SF), "test-awkward")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert ids and ids.count(20) <= 1 and not {100, 101} & set(ids)  # what is left of a group is its first document
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
