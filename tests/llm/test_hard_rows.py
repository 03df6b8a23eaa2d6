"""Many rows without an id, repeated ids, extreme ids, hot rows, long texts, clashing names: against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

BIG = (1 << 63) - 1
CLASH = "doc_id long, text string, n_chars long, _key string, Score double, ids string, found int, row int, IDENT string"


def prose(rng, n):
    return " ".join(f"{rng.choice('ka lo mi ne pu ra so ti'.split())}{rng.randint(0, 9999)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t), "k", 0.5, "x", 1, 2, "y") for i, t in rows], CLASH).repartition(4)


def removed(rows):
    """Words left by the rule of windows; rows are (doc_id, text), without an id last, then by Spark's hash of the text."""
    seen, out = set(), {}
    for i, _, t in rows:
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        out[i, t] = (i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def many():
    rng = random.Random(11)
    passage = prose(rng, 30)
    rows = [(None, f"{prose(rng, rng.randint(0, 8))} {passage} {prose(rng, rng.randint(0, 8))}") for _ in range(2000)]
    rows += [(7, f"{passage} {prose(rng, 25)}"), (7, prose(rng, 40)), (7, rows[3][1]), (-1, prose(rng, 22)), (BIG, rows[5][1]), (BIG, prose(rng, 30)), (None, None), (-1, None)]
    return rows + [rows[9]] * 300


def test_fingerprint_log_tells_rows_apart(spark, many):
    from tidemark.llm.fingerprint_log import _rows_of, dedup

    df = frame(spark, many)
    order = {(r.doc_id, r.text): (r.id, r.k) for r in _rows_of(df).collect()}
    ranked = sorted({(i, order[i, t], t) for i, t in many}, key=lambda x: x[1])
    want = removed(ranked)
    got = sorted((tuple(r) for r in dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == sorted((want[x] for x in many), key=repr)


def test_log_grows_over_sessions(spark, tmp_path):
    from tidemark.llm.fingerprint_log import FingerprintLog, _rows_of, dedup_batch

    rng = random.Random(12)
    passages = [prose(rng, 45) for _ in range(6)]
    rows = [(i, f"{prose(rng, 12)} {rng.choice(passages)} {prose(rng, 30)}") for i in range(90)]
    df = frame(spark, rows)
    order = {(r.doc_id, r.text): (r.id, r.k) for r in _rows_of(df).collect()}
    want = removed(sorted(((i, order[i, t], t) for i, t in rows), key=lambda x: x[1]))
    path, got = f"file:{tmp_path}/log", {}
    for b in range(3):
        session = spark.newSession()
        log = FingerprintLog(session, path, buckets=64)
        assert log.version >= b
        for run, _ in log.runs:
            spark.sql(f"DROP TABLE IF EXISTS {log._name(run)}")  # a session elsewhere knows no tables
        log = FingerprintLog(session, path)
        batch = frame(spark, rows[30 * b : 30 * b + 30])
        for r in dedup_batch(batch, log).collect():
            got[r.doc_id] = (r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
        assert len(log.runs) <= 2
    assert got == {i: x for (i, _), x in want.items()} and sum(x[2] > 0 for x in got.values()) > 60
    log.drop()


def test_redaction_tells_rows_apart(spark):
    from tidemark.llm.secrets import redact, scan

    secret = "password = hunter22x and more"
    rows = [(-1, secret), (None, secret), (BIG, secret), (-1, "plain"), (None, None), (None, secret), (4, "token: abcdefgh " * 3)]
    df = frame(spark, rows)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in redact(df).collect()), key=repr)
    shown = lambda t: t and re.sub(r"(password = |token: )\w+", "[SECRET]", t)
    assert got == sorted(((i, shown(t), None if t is None else len(shown(t))) for i, t in rows), key=repr) and redact(df).columns == df.columns
    assert scan(df).count() == len(rows) and scan(df).where("n_assign = 1").count() == 4


def test_dense_long_text_is_scanned_in_line(spark):
    from tidemark.llm.secrets import redact, scan

    n = 20000
    text = "é token=abcdefg1 x " * n
    df = frame(spark, [(1, text)])
    r = scan(df).first()
    assert r.n_assign == n and r.spans.startswith("assign:2:16,assign:21:35") and r.spans.endswith(f"assign:{19 * (n - 1) + 2}:{19 * (n - 1) + 16}")
    assert redact(df).first().text == "é [SECRET] x " * n


def test_near_copies_without_ids(spark):
    from tidemark.llm.simhash import keep_one

    rng = random.Random(13)
    texts = [prose(rng, 60) for _ in range(300)]
    rows = [(None, t) for t in texts] + [(5, t) for t in (prose(rng, 60) for _ in range(4))] + [(None, texts[0] + " tail"), (9, texts[1] + " tail")]
    df = frame(spark, rows + [rows[2]] * 50)
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    first = {r.text for r in df.select("text").where(F.col("text").isin(texts[0], texts[0] + " tail")).orderBy(F.xxhash64("text")).limit(1).collect()}
    want = [(i, t) for i, t in rows if t not in (texts[0], texts[0] + " tail", texts[1])] + [(None, t) for t in first]
    assert got == sorted(want, key=repr)


def test_one_and_two_bits_apart(spark, monkeypatch):
    from tidemark.llm import simhash as S

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 63, len(x)).astype(np.uint64))
    one = flip(base[:200])
    two = flip(one[:100])
    fps = np.unique(np.r_[base, one, two])
    df = spark.createDataFrame([(i, int(x.view(np.int64))) for i, x in enumerate(fps)], "rep long, f0 long")
    rows = df.select("f0", "rep", F.explode(S._cells(2)).alias("cell"))
    near = {(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near:
        root[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: top(i) for i in range(len(fps)) if any(top(j) == top(i) for j in range(len(fps)) if j != i)}
    assert len(want) > 300
    for size in (4096, 3):
        monkeypatch.setattr(S, "TILE_ROWS", size)
        monkeypatch.setattr(S, "ANCHORS", 2)
        assert {r.node: r.label for r in S.components(S._tile_links(rows, ["f0"], 2)).collect()} == want


def test_slots_split_repeats_and_the_map_goes_on(spark):
    from tidemark.llm.sharding import SlotMap, assign

    rng = random.Random(14)
    rows = [(1, "x" * 1000)] * 2000 + [(i, prose(rng, rng.randint(1, 5))) for i in range(2000)] + [(None, "x" * 999)] * 50
    df = frame(spark, rows)
    slot_map = SlotMap(spark)
    first = assign(df, 8, slot_map=slot_map)
    size = [r.s for r in first.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(size) == 8 and max(size) - min(size) <= 0.02 * sum(size) / 8
    before = slot_map.load()
    assert assign(df, 8, slot_map=slot_map).count() == len(rows) and slot_map.version() == 2 and (slot_map.load() == before).all()
    grown = assign(df, 9, slot_map=SlotMap(spark, slot_map.path))
    size = [r.s for r in grown.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    moved = slot_map.load() != before
    assert len(size) == 9 and max(size) - min(size) <= 0.02 * sum(size) / 9 and (slot_map.load(2) == before).all() and grown.first().map_version == 3
    load = np.zeros(8192)
    for r in grown.groupBy("vslot").agg(F.sum("size").alias("s")).collect():
        load[r.vslot] = r.s
    assert load[moved].sum() < 0.2 * load.sum()
    with pytest.raises(ValueError):
        slot_map.publish(9, {})


def test_ftrl_equals_the_written_rule():
    from tidemark.llm import toxicity as T

    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 40, rng.integers(0, 9))), int(rng.random() < 0.4)) for _ in range(60)]
    a, b, l1, l2, lift = 1.0, 1.0, 8.0, 1.0, np.sqrt(sum(y == 0 for _, y in rows) / sum(y for _, y in rows))
    z, n, w, order = defaultdict(float), defaultdict(float), {}, np.random.default_rng(0)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + np.sqrt(n[i])) / a + l2)
    for _ in range(5):
        for k in order.permutation(len(rows)):
            at, y = [*rows[k][0].tolist(), 1 << T.BITS], rows[k][1]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (lift if y else 1.0)
            for i in at:
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / a * w[i]
                n[i] += g * g
    got = T.fit(rows)
    assert max(abs(got[i] - weight(i)) for i in [*range(40), 1 << T.BITS]) < 1e-5 and not got[40:-1].any()


def test_toxicity_takes_clashing_names_and_repeated_ids(spark, monkeypatch):
    from tidemark.llm import toxicity as T

    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(30)) + (" vile" if i % 3 == 0 else "")) for i in range(300)] + [(3, "ab cd ef")] * 400
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    kept = T.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.where("text like '%vile'").count() == 0 and kept.where("doc_id % 3 <> 0").count() == 200
    sample = T.sampled(df, labels, 100, None, 5)
    assert sample.count() == 100 and sample.select("doc_id").distinct().count() == 100
    few = T.sampled(df, labels, 300, None, 5, sample_bytes=1000)
    assert 5 < few.count() < 20


def test_tree_scores_equal_a_tree_of_dictionaries(spark):
    from tidemark.llm import suffix_tree_lm as S

    rng = random.Random(16)
    text = lambda: " ".join(x for _ in range(rng.randint(0, 25)) for x in rng.choice([("a", "b", "c"), ("b", "a", "d", "e"), ("e",), (f"r{rng.randint(0, 60)}",)]))
    rows = [(i, text()) for i in range(250)] + [(None, "a b c a"), (400, None)]
    df = frame(spark, rows)
    for depth in (1, 3):
        got = {(r.doc_id, r.n_tokens): r for r in S.score_documents(df, depth=depth).collect()}
        crc = lambda i: __import__("zlib").crc32(("" if i is None else str(i)).encode()) % 5
        train = [[None, *(t or "").split(), None] for i, t in rows if crc(i) != 1]
        count = defaultdict(lambda: defaultdict(int))
        for w in train:
            for k in range(depth + 1):
                for j in range(k, len(w)):
                    if k or j:
                        count[tuple(w[j - k : j])][w[j]] += 1
        base = count[()]
        total, kinds = sum(base.values()), len(base)
        times = {c: sum(x.values()) for c, x in count.items()}
        prob = {(w,): (n + 0.5) / (total + 0.5 * (kinds + 1)) for w, n in base.items()}
        unseen, states = 0.5 / (total + 0.5 * (kinds + 1)), {}
        for k in range(1, depth + 1):
            for ctx in [c for c in count if len(c) == k]:
                if k == 1 and (base.get(ctx[0], 0) if ctx[0] is not None else len(train)) < 2:
                    continue
                listed = {x: n for x, n in count[ctx].items() if n >= 2 and ctx[1:] + (x,) in prob}
                if not listed:
                    continue
                q = {x: prob[ctx[1:] + (x,)] for x in listed}
                own = {x: (n + 4.0 * q[x]) / (times[ctx] + 4.0) for x, n in listed.items()}
                rest, left = times[ctx] - sum(listed.values()), 1 - sum(q.values())
                ratio = sum(n * np.log(n / times[ctx] / q[x]) for x, n in listed.items()) + (rest * np.log(rest / times[ctx] / left) if rest else 0)
                stays = ratio >= 12.0
                if stays:
                    states[ctx] = (own, max(1 - sum(own.values()), 1e-12) / max(left, 1e-12))
                for x in listed:
                    prob[ctx + (x,)] = own[x] if stays else q[x]

        def chance(before, w):
            for k in range(min(depth, len(before)), 0, -1):
                ctx = tuple(before[-k:])
                if ctx in states:
                    own, share = states[ctx]
                    return own[w] if w in own else share * chance(before[1 - k :] if k > 1 else [], w)
            return prob.get((w,), unseen)

        assert states
        for i, t in rows:
            w = [None, *(t or "").split(), None]
            want = sum(np.log10(chance(w[max(0, j - depth) : j], w[j])) for j in range(1, len(w)))
            assert got[i, len(w) - 1].score == pytest.approx(want, abs=1e-3), (depth, t)


def test_unspaced_text_is_encoded_in_line():
    import time

    from tidemark.llm import viterbi as V

    vocabulary = V.Vocabulary.load()
    rng = random.Random(17)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40000))
    start = time.time()
    ids, at, _ = V.encode([text, "a b", text[:5000]], vocabulary)
    assert [x.decode() for x in V.decode(ids, at, vocabulary)] == [text, "a b", text[:5000]] and time.time() - start < 5


def test_repeated_windows_travel_packed(spark, tmp_path):
    from tidemark.llm.fingerprint_log import FingerprintLog, _rows_of

    def shuffled():
        context = spark.sparkContext
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    rng = random.Random(18)
    texts = [prose(rng, 220) for _ in range(150)]
    log, before = FingerprintLog(spark, f"file:{tmp_path}/log", buckets=64), shuffled()
    first = log.append(_rows_of(frame(spark, list(enumerate(texts + texts))))).collect()
    second = log.append(_rows_of(frame(spark, list(enumerate(texts, 300))))).collect()
    assert sorted(r.id for r in first + second) == list(range(150, 450)) and all(sorted(r.marks) == list(range(201)) for r in first + second)
    assert shuffled() - before < 15000  # of 90,450 windows, all of which are repeated
    log.drop()
