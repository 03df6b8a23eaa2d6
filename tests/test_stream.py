"""The fold on streams with facts in any order, and the chained queries, with crashes between and within them."""

import glob
import os
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B
from tidemark.streaming import detector as D
from tidemark.streaming import fold as S
from tidemark.streaming.topology import FACT, POLL, Topology, claims_as_facts

DAY0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
STAMPS = ("valid_from", "valid_to", "recorded_at")


def day(n):
    return DAY0 + timedelta(days=n)


def made_facts(seed, n):
    """Facts of three keys with changes, corrections, conflicts, reaffirmations and ties in time."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = rng.choice([None, *range(0, 40, 4)])
        end = None if start is None or rng.random() < 0.6 else day(start + rng.choice([4, 9, 30]))
        rows.append((rng.choice("AB"), rng.choice(["ceo", "ceo", "city"]), i, rng.choice("xyzZ"), None if start is None else day(start), end, day(rng.randint(0, 60)), rng.choice("pqr"), [f"d{i}"], 0.5))
    return rows


def listed(df):
    return sorted((tuple(r[c] for c in B.VERSION) for r in df.collect()), key=repr)


def arrive(spark, rows, folder, name):
    """One file of facts, in this order of arrival."""
    spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def folded(spark, tmp_path, **options):
    stream = spark.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = S.fold_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    return S.versions_of(spark.read.schema(S.CHANGES).parquet(str(tmp_path / "out")))


@pytest.mark.parametrize("mode", ["reference", "bitemporal"])
def test_any_order_and_batches_give_the_batch_fold(spark, tmp_path, mode):
    rows = made_facts(3, 60)
    want = listed(B.assert_facts(spark.createDataFrame(rows, FACT), mode))
    arrival = list(rows)
    random.Random(9).shuffle(arrival)
    cuts = [0, 7, 8, 30, 60]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        arrive(spark, arrival[a:b] + arrival[: a // 2], tmp_path / "in", f"b{k}")  # earlier facts come again
        if k in (1, 3):  # a restart with more input each time
            got = folded(spark, tmp_path, mode=mode)
    assert listed(got) == want and len(want) > 20
    revised = spark.read.schema(S.CHANGES).parquet(str(tmp_path / "out"))
    assert revised.agg(F.max("revision")).first()[0] > 1 and revised.count() > len(want)


def test_bounded_lateness_settles_the_past(spark, tmp_path):
    early = [("A", "ceo", i, "xy"[i % 2], day(i), None, day(i), "p", [], 0.5) for i in range(30)]
    arrive(spark, early[:20], tmp_path / "in", "b0")
    folded(spark, tmp_path, late="5 days")
    arrive(spark, early[22:], tmp_path / "in", "b1")
    folded(spark, tmp_path, late="5 days")
    in_time = ("A", "ceo", 77, "z", day(27), None, day(28), "q", [], 0.5)
    too_late = ("A", "ceo", 78, "w", day(3), None, day(3), "q", [], 0.5)
    arrive(spark, [in_time, too_late], tmp_path / "in", "b2")
    got = folded(spark, tmp_path, late="5 days")
    kept = [*early[:20], *early[22:], in_time]
    assert listed(got) == listed(B.assert_facts(spark.createDataFrame(kept, FACT)))


def test_facts_without_a_place_are_left_out(spark, tmp_path):
    rows = [("A", "ceo", 1, "x", None, None, day(1), None, None, 0.5), (None, "ceo", 2, "x", None, None, day(1), "p", [], 0.5), ("A", "ceo", 3, "y", day(1), None, None, "p", [], 0.5), ("A", "ceo", 1, "x", None, None, day(1), None, None, 0.5)]
    arrive(spark, rows, tmp_path / "in", "b0")
    assert [(r.value, r.seq) for r in folded(spark, tmp_path).collect()] == [("x", 1)]


# ---- chained queries


def poll(source, n, text, when=None):
    return (source, day(n), n, text, None, None, None if when is None else day(when), "Acme Industries", f"http://{source}/{n}")


POLLS = [
    [poll("s1", 1, "Acme Industries named Ada Park chief executive officer in January 2020.", 0), poll("s2", 1, "Acme Industries revenue was 5 million in 2023."), poll("s1", 2, "Acme Industries named Ada Park chief executive officer in January 2020.", 0), (None, day(2), 2, "no source", None, None, None, None, None)],
    [poll("s1", 4, "Acme Industries named Lena Voss chief executive officer in March 2024.", 3), poll("s2", 3, None), poll("s2", 5, "Acme Industries revenue was 7 million in 2023.")],
    [poll("s3", 3, "Acme Industries named Yuki Tanaka chief executive officer in February 2024.", 2), poll("s2", 6, "Acme Industries revenue was 7 million in 2023.")],  # s3 reports late what lies before s1's second poll
]


def topology(spark, tmp_path):
    return Topology(spark, str(tmp_path / "top"), lambda: spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "polls" / "*")))


def forget_last_commit(tmp_path, stage):
    """As after a crash between a batch's output and its commit: the batch runs again."""
    commits = sorted((f for f in glob.glob(str(tmp_path / "top" / "checkpoints" / stage / "commits" / "*")) if re.fullmatch(r"\d+", os.path.basename(f))), key=lambda f: int(os.path.basename(f)))
    assert commits
    os.remove(commits[-1])
    crc = os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_chained_queries_lose_and_double_nothing(spark, tmp_path):
    top = topology(spark, tmp_path)
    for k, rows in enumerate(POLLS):
        spark.createDataFrame(rows, POLL).coalesce(1).write.parquet(str(tmp_path / "polls" / f"p{k}"))
        if k == 1:  # killed after the first two queries; the rest starts with what they committed
            for name in ("changed", "dead"):
                top.start(name).awaitTermination()
            for name in ("changed", "dead"):
                forget_last_commit(tmp_path, name)
            top = topology(spark, tmp_path)
        top.run()
        for name in ("changed", "dead", "facts", "versions"):
            before = sorted(map(repr, top.table(name).collect()))
            forget_last_commit(tmp_path, name)
            top.start(name).awaitTermination()
            assert sorted(map(repr, top.table(name).collect())) == before, name
    polls = spark.createDataFrame([r for rows in POLLS for r in rows], POLL)
    good = polls.where("source_id is not null and text is not null")
    changed = D.detect_batch(good, D.NEAR_BITS).where("changed")
    assert sorted((r.source_id, r.seq) for r in top.table("changed").collect()) == sorted((r.source_id, r.seq) for r in changed.collect()) == [("s1", 1), ("s1", 4), ("s2", 1), ("s2", 5), ("s3", 3)]
    assert top.table("dead").count() == 2
    want = B.assert_facts(claims_as_facts(changed))
    assert listed(top.versions()) == listed(want) and want.count() >= 4
    ceo = {r.value: (r.valid_from, r.valid_to) for r in top.versions().where("attribute = 'ceo'").collect()}
    assert ceo["Yuki Tanaka"][1] == ceo["Lena Voss"][0] and ceo["Ada Park"][1] == ceo["Yuki Tanaka"][0]
    assert {r.new_value for r in top.feed(kind="CHANGED").collect()} >= {"Lena Voss"}
