import random
import re

import numpy as np

from quillon.llm import neardup

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = SEP.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    seen = set()
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                seen.add((own[a], own[b]))
    for a, b in seen:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def make(n, seed=1):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            w = rnd.choice(out[-30:]).split(" ")
            w = list(w)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab).upper()
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 120))))
    return out


def test_groups_follow_brute_force(spark, monkeypatch):
    rows = list(enumerate([*make(260), *["the same words in each of forty texts"] * 40]))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, keys string")
    assert got(neardup.groups(df, 3, 85)) == brute(rows, 3, 85)
    for hot in (1, 30, 1000):  # no set of equal texts is dealt out, the large ones, all
        monkeypatch.setattr(neardup.common, "HOT", hot)
        assert got(neardup.groups(df)) == brute(rows, 5, 80)


def test_chain_that_stars_cannot_finish(spark):
    base = ["b%d" % i for i in range(60)]
    rows = []
    for i in range(25):  # each differs from the last by a little, the ends have nothing in common
        base[2 * i % 60] = "c%d" % i
        base[(2 * i + 1) % 60] = "d%d" % i
        rows.append((i * 7 % 25, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.groups(df, 3, 85)) == brute(rows, 3, 85)


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a"), (7, "same same same same"), (8, "same same same same")]
    df = spark.createDataFrame([*rows, (None, "a b"), (None, None)], "doc_id long, text string")
    r = neardup.groups(df, 3, 85).collect()
    assert len(r) == 10 and [x.kept for x in r if x.doc_id is None] == [True, True]
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in r if x.doc_id} == brute(rows, 3, 85)
    assert neardup.groups(df.limit(0), 3, 85).count() == 0


def test_rows_that_repeat_an_id_are_nodes_of_their_own(spark):
    word = lambda k, n=101: ["%s%d" % (k, i) for i in range(n)]
    a, b = word("a"), word("b")
    rows = [(1, " ".join(b)), (1, " ".join(a)), (2, " ".join(["z", *a[1:]])), (5, " ".join(["y", *b[1:]])), (5, "alone in the world"), (7, "alone in the world")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(df, 3, 85).collect())
    assert out == [(1, 99, 1, True), (1, 99, 1, True), (2, 99, 1, False), (5, 2, 5, True), (5, 99, 1, False), (7, 2, 5, False)]
    kept = sorted((r.doc_id, r.text[:5]) for r in neardup.keep_one_each(spark, df.selectExpr("*", "1 AS mark", "2 AS gone"), "").collect())
    assert kept == [(1, "a0 a1"), (1, "b0 b1"), (5, "alone")]


def test_very_long_text(spark):
    words = ["w%d" % (i * i % 99_991) for i in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-9])), (3, "w1 w2 w3")], "doc_id long, text string")
    assert [got(neardup.groups(df))[i][1] for i in (1, 2, 3)] == [1, 1, 3]


def test_sketches_estimate_similarity_and_fill():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    a, b, one = np.sort(base[:2000]), np.sort(base[500:2500]), base[:1]
    s = neardup.sketches(np.array([0, 2000, 4000, 4001]), np.concatenate((a, b, one)), 500)
    assert not (s == neardup.EMPTY).any()
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.08


def test_tiles_find_what_stars_miss(spark, monkeypatch):
    rnd = random.Random(4)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(120):  # each far from the base, some near to one another
        w = list(base)
        for p in rnd.sample(range(150), 6):
            w[p] = "e%d" % i
        rows.append((2 * i, " ".join(w)))
        w[rnd.randrange(150)] = "f"
        rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "STARS", 0)
    monkeypatch.setattr(neardup, "TILE", 32)
    assert got(neardup.groups(df, 3, 85)) == brute(rows, 3, 85)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(neardup.op9_minhash_near_dedup(spark, sf)) == brute(rows, 3, 85)
