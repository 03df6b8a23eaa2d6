"""Delta-maintained Lloyd, tensored MinHash tables and the replay of filters: against brute force, hard rows included."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

BIG = (1 << 63) - 1
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(f"{rng.choice('Ka lo mi ne pu ra so ti'.split())}{rng.randint(0, 9999)}" for _ in range(n))


# ---- delta Lloyd


def lloyd(rows, rounds=2, parts=16, entries=64):
    """Written-out rounds over rows (vec_id, label, vector): one (vec_id, label, code, error) each, and the codebooks."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(good[0][2]) // parts
    cut = lambda q, p: q[p * w : p * w + w]
    first = sorted({i for i, _, _ in good if i is not None})[:entries]
    books = [[cut(min(q for j, _, q in good if j == i), p) for i in first] for p in range(parts)]

    def near(q, book):
        d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, _, q in good:
                held[near(cut(q, p), books[p])[0]].append(cut(q, p))
            for e, members in held.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for i, lab, q in good:
        got = [near(cut(q, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, code string, Q int, _label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, lab, v in rows], VECTORS).repartition(3)


def check(df, rows):
    from tidemark.llm.delta_lloyd import compress

    want, digest = lloyd(rows)
    total = defaultdict(int)
    for _, lab, _, e in want:
        total[lab] += e
    got = [tuple(r) for r in compress(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, c, e, total[lab], digest) for i, lab, c, e in want), key=repr)


def test_lloyd_equals_the_written_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [None, 1, 2][i % 3], [float(x) for x in np.float32(rng.normal(size=32))]) for i in range(200)]
    rows += [(900 + i, 7, rows[0][2]) for i in range(150)]  # a hot vector and label
    rows += [rows[5]] * 3 + [(5, 1, rows[9][2]), (None, 1, rows[3][2]), (-4, 2, rows[4][2]), (BIG, None, rows[8][2])]
    rows += [(301, 1, None), (302, 1, []), (303, 1, [math.nan] * 32), (304, 1, [1.0] * 31 + [None]), (305, 2, [math.inf] + [0.0] * 31)]
    check(vectors(spark, rows), rows)


def test_lloyd_of_few_none_and_ragged_vectors(spark):
    from tidemark.llm.delta_lloyd import compress

    few = [(3, None, [0.5] * 16), (9, 1, [-0.25] * 16), (9, 1, [0.125] * 16)]
    check(vectors(spark, few), few)
    assert compress(vectors(spark, few).limit(0)).collect() == []
    assert compress(vectors(spark, [(1, 1, None)])).collect() == []
    ragged = vectors(spark, [*few, (10, 1, [1.0] * 3)])
    assert {r.vec_id for r in compress(ragged).collect()} == {3, 9}
    padded = vectors(spark, [(i, 1, [float(i), 0.5, -1.0]) for i in range(5)]).drop("label")
    got = compress(padded).collect()
    assert len(got) == 5 and all(r.error == 0 and len(r.code) == 32 for r in got)
    assert len(compress(vectors(spark, [(None, 1, [0.5] * 16), (None, 1, [0.25] * 16)])).collect()) == 2
    assert compress(vectors(spark, [(1, 1, [3e38] * 16), (2, 1, [-3e38] * 16)])).count() == 2


def test_lloyd_rounds_shuffle_only_what_moved(spark):
    from tidemark.llm import delta_lloyd as D

    rng = np.random.default_rng(6)
    rows, dim = D._integers(vectors(spark, [(i, 1, [float(x) for x in rng.normal(size=32)]) for i in range(300)]), 16)
    rows = rows.cache()
    books = D._first_entries(rows, 16, 8, dim)
    first = D._assigned(rows, books, dim)
    again = D._assigned(first, books, dim)
    assert D._contributions(again, 16, 8, dim).count() == 0  # same codebooks: nothing moves
    moved = books.copy()
    moved[0, 0] += 10_000  # one entry of one part goes away
    after = D._assigned(first, moved, dim)
    delta = D._contributions(after, 16, 8, dim).collect()
    assert {r.part for r in delta} == {0}
    assert sum(r.total for r in delta if r.place == 0) == 0 and any(r.total < 0 for r in delta if r.place == 0)

    def summed(contributions):
        sums = defaultdict(int)
        for r in contributions:
            sums[r.part, r.entry, r.place] += r.total
        return {k: v for k, v in sums.items() if v}

    whole = D._contributions(D._assigned(rows, moved, dim), 16, 8, dim).collect()
    assert summed(D._contributions(first, 16, 8, dim).collect() + delta) == summed(whole)


# ---- tensored MinHash


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def classes(rows):
    """Component of each row by brute force over full sets; rows are (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least.get(top(i)), d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], "doc_id long, text string, Size int, s0 int, N string").repartition(4)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(21)
    rows = []
    for k in range(40):  # families whose members lie above, at and below the bar
        base = prose(rng, rng.choice([9, 30, 80, 300])).split()
        rows.append((10 * k, " ".join(base)))
        for v in range(1, 6):
            other = list(base)
            for at in rng.sample(range(len(other)), k=max(0, min(len(other) - 1, len(other) * v // 90))):
                other[at] = f"new{rng.randint(0, 99999)}"
            rows.append((10 * k + v, " ".join(other + [f"tail{rng.randint(0, 9)}"] * (v % 2))))
    rows += [(None, rows[0][1]), (None, prose(rng, 50)), (None, prose(rng, 50)), (7777, None), (7778, ""), (None, "  \t\n"), (-5, "a b c"), (BIG, "A  b\nC"), (8001, "a b"), (8002, rows[6][1].upper() if rows[6][1].isascii() else "x")]
    rows += [(3, prose(rng, 40)), (3, prose(rng, 40)), (4, "la " * 30000), (8003, "la " * 20000)]
    return rows + [rows[12]] * 40


def test_tensored_minhash_equals_brute_force(spark, copies):
    from tidemark.llm.minhash_tables import near_duplicates

    got = near_duplicates(frame(spark, copies))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(d, n, d if n == 0 else c, (d if n == 0 else c) == d) for d, n, c, _ in classes(copies)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(c is not None and c != d for d, n, c, _ in want) > 100
    assert near_duplicates(frame(spark, copies).limit(0)).collect() == []


def test_tables_meet_as_their_formula_says():
    """Share of pairs of a known similarity that share a key of both collections."""
    from tidemark.llm import minhash_tables as M

    rng = np.random.default_rng(1)
    for s, least, most in ((0.9, 0.999, 1), (0.8, 0.995, 1), (0.5, 0.35, 0.7), (0.2, 0, 0.02)):
        n, hits = 600, 0
        both = round(2 * n * s / (1 + s))
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            sets = np.r_[x[:n], x[n - both :]]
            a, b = M.half_keys(M.minima(sets, np.array([n, n])))
            hits += np.isin(a[: M.HALVES], b[: M.HALVES]).any() and np.isin(a[M.HALVES :], b[M.HALVES :]).any()
        assert least <= hits / 200 <= most, (s, hits)


def test_minima_and_sketches_of_sets_over_chunks(monkeypatch):
    from tidemark.llm import minhash_tables as M

    rng = np.random.default_rng(2)
    sizes = np.array([1, 50, 3, 700, 2, 1])
    grams = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    whole = M.minima(grams, sizes)
    ends = np.cumsum(sizes)
    assert all((whole[i] == (grams[e - n : e, None] * M._MULTIPLY).min(axis=0)).all() for i, (e, n) in enumerate(zip(ends, sizes, strict=True)))
    monkeypatch.setattr(M, "_CHUNK", 37)
    assert (M.minima(grams, sizes) == whole).all()
    apart = []
    for _ in range(100):  # similarity 0.8: 450 of 500 each
        x = rng.integers(0, 1 << 63, 500 + 56, dtype=np.uint64)
        a, b = M.sketches(M.minima(np.r_[x[:500], x[56:]], np.array([500, 500])))
        apart.append(int(np.bitwise_count(a ^ b).sum()))
    assert 10 < np.mean(apart) < 16 and max(apart) <= M.RADIUS


def test_hot_group_of_near_copies_makes_stars_not_pairs(spark, monkeypatch):
    from tidemark.llm import minhash_tables as M
    from tidemark.llm import skew

    monkeypatch.setattr(skew, "HOT", 4)  # the broadcast side is used at this size too
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = []
    for i in range(300):
        other = list(base)
        other[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(other)))
    rows += [(1000 + i, prose(rng, 60)) for i in range(100)]
    made = []
    real = M.candidates
    monkeypatch.setattr(M, "candidates", lambda nodes: made.append(real(nodes)) or made[-1])
    monkeypatch.setattr(M, "discard", lambda *t: None)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for (i, _), (_, _, c, _) in zip(rows, classes(rows), strict=True)}
    assert made[0].count() < 300 * 40  # at most one link for each member and table, and most tables agree


# ---- filter replay


def replayed(docs, labels):
    """Written-out replay over docs (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                mine = [r for r in rows if r[0] == part and f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_filter_replay_equals_the_written_replay(spark, monkeypatch):
    from tidemark.llm import filter_audit as A
    from tidemark.llm import skew

    rng = random.Random(4)
    texts = [prose(rng, rng.choice([3, 60, 90])) + rng.choice(["", " 50% off", " x|y", " " + "la " * 80]) for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice(["web", "web", "book", None, ""])) for i in range(120)]
    docs += [(None, texts[0], "web"), (None, None, None), (5, texts[1], "web"), (5, texts[1], "web"), (-9, texts[2], "book"), (BIG, texts[2], "book"), (700, "É" * 60 + " ABC", "book"), (701, None, "web"), (702, "", "web"), (703, "Ab " * 40000, "web")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99999, 1, 1), (6, None, None)]
    df = spark.createDataFrame([(*d, 1, True, "x") for d in docs], "doc_id long, text string, source string, failed int, good boolean, Part string").repartition(3)
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, part int")
    want = replayed(docs, labels)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for hot in (1024, 4):
        monkeypatch.setattr(skew, "HOT", hot)
        got = A.audit(df, marks)
        assert got.columns == columns and sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} == {"", "web", "book"} and len(want) == 1800
    assert A.audit(df.limit(0), marks).collect() == []
    assert A.audit(df, marks.limit(0)).count() == 1800


def test_counted_join_takes_every_row_once(spark):
    from tidemark.llm.skew import HOT, joined

    rows = spark.range(5000).selectExpr("if(id < 3000, 1, id) as k", "id as v")
    groups = rows.groupBy("k").agg({"*": "count"}).toDF("k", "n").where("k <> 4999").selectExpr("k", "n", "k * 2 as w")
    got = joined(rows, groups, ["k"], 5000)
    assert 3000 > 5000 / HOT and got.columns == ["k", "v", "w"]
    assert sorted((r.v, r.w) for r in got.collect() if r.w is not None) == [(v, 2 if v < 3000 else 2 * v) for v in range(4999)]
    assert got.count() == 5000 and joined(rows, groups, ["k"], 5000, "inner").count() == 4999
