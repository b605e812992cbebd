import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quillon.llm import fmindex, substring

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    first = {}
    words = [(i, SEP.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone[p : p + window] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in df.collect())


def make(n, seed=3):
    rnd = random.Random(seed)
    passages = [[f"p{k}.{i}" for i in range(rnd.randint(20, 160))] for k in range(8)] + [["x"] * 120, ["a", "b", "c"] * 40]
    rows = []
    for i in rnd.sample(range(1000), n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            s = rnd.randint(0, 30)
            w += p[s:] + [f"u{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 20))]
        if w and rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = "edit"
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    return rows


def test_follows_brute_force(spark, monkeypatch):
    rows = make(120) + [(5000, None), (5001, ""), (None, "x " * 200), (None, None), (5002, " ".join(f"p0.{i}" for i in range(20))), (5003, "x " * 130), (5003, "x " * 130), (5003, "other " * 60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, mark_ int").drop("mark_")
    assert got(substring.removal(df)) == brute(rows)
    monkeypatch.setattr(substring, "GROUP", 2)  # parts of a hot anchor
    monkeypatch.setattr(substring, "SHARD", 128)
    assert got(substring.removal(df)) == brute(rows)
    for hot in (1, 30):  # no anchor is dealt out, the large ones; above: all
        monkeypatch.setattr(substring.common, "HOT", hot)
        assert got(substring.removal(df)) == brute(rows)
    assert substring.removal(df.limit(0)).count() == 0


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "w " * 60, "k", 7, 8), (2, "w " * 60 + "z", "k", 7, 8)], "doc_id long, text string, spans string, n_chars long, mark int")
    out = {r.doc_id: r for r in substring.cut_repeats(spark, df, "").collect()}
    assert out[1].text == "w " * 60 and out[2].text == "z" and out[2].n_chars == 1 and out[2].spans == "k" and out[2].mark == 8


def test_index_counts_and_ranks():
    rnd = np.random.default_rng(0)
    v = rnd.integers(0, 11, 1000)
    m = fmindex.WaveletMatrix(v, 4)
    s, p = rnd.integers(0, 11, 300), rnd.integers(0, 1001, 300)
    assert m.rank(s, p).tolist() == [int((v[:j] == c).sum()) for c, j in zip(s, p)]


def test_index_finds_windows_of_other_texts():
    rnd = np.random.default_rng(1)
    text = [rnd.integers(1, 4, rnd.integers(6, 30)) for _ in range(20)]
    index = fmindex.FMIndex(np.concatenate(text), np.cumsum([0, *map(len, text)]), np.arange(20)[::-1].copy(), 6, 4)
    query = [rnd.integers(0, 4, rnd.integers(6, 40)) for _ in range(30)]
    out = index.matches(np.concatenate(query), np.cumsum([0, *map(len, query)]), 99)
    want = []
    for q in query:
        for p in range(len(q) - 5):
            hit = [19 - i for i, t in enumerate(text) if any((t[j : j + 6] == q[p : p + 6]).all() for j in range(len(t) - 5))]
            want.append(min(hit, default=99))
    assert out.tolist() == want and min(want) < 99


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = substring.op3_substring_dedup(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute(rows)
    assert sum(r.n_removed for r in out)


def test_texts_beyond_the_limit_are_looked_at_in_pieces():
    rnd = random.Random(6)
    texts = pa.array([" ".join(rnd.choices("abcdefgh", k=n)) for n in (700, 0, 49, 50, 130, 260)])
    whole, cut = substring.segments(texts, 50, 8), substring.segments(texts, 50, 8, 120)

    def windows(found):  # each window with its anchor, however segments are cut
        row, start, number, anchor, _ = found
        return sorted((int(r), int(s) + k, int(a)) for r, s, n, a in zip(row, start, number, anchor) for k in range(n))

    assert windows(whole) == windows(cut) and len(windows(cut)) == 651 + 1 + 81 + 211


def test_shards_stay_bounded_and_find_what_one_index_finds():
    rnd = random.Random(7)
    base = ["w%d" % i for i in range(90)]
    rows = []
    for anchor, size in ((1, 3), (2, 60), (3, 5), (4, 2)):
        for k in range(size):
            w = [f"{anchor}.{x}" for x in base[:70]]
            w[rnd.choice([0, 1, 68, 69])] = "x%d" % rnd.randrange(3)
            rows += [(anchor, 100 * anchor + k, 21, part, part == k % 2, 1000 * anchor + rnd.randrange(500), " ".join(w)) for part in (0, 1)]
    rows.sort(key=lambda r: (r[0], r[3], not r[4]))
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("number", pa.int32()), ("part", pa.int32()), ("own", pa.bool_()), ("owner", pa.int64()), ("words", pa.string())])
    whole = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    whole = whole.append_column("slice", pa.array([0] * len(rows), pa.int32()))

    def run(size):
        out, shard, most = {}, None, 0
        for t, new in substring.blocks(iter(whole.to_batches(max_chunksize=7)), size):
            if new:
                shard = substring.Shard(t.filter(t["own"]), 50)
                most = max(most, t.filter(t["own"]).num_rows)
            for r in shard.search(t.combine_chunks()).to_pylist():
                for x in r["runs"]:
                    for k in range(x["first"], x["end"]):
                        at = r["anchor"], r["content"], k
                        out[at] = min(x["owner"], out.get(at, x["owner"]))
        return out, most

    assert run(8)[0] == run(10_000)[0] and run(8)[1] < 45 < run(10_000)[1]
