import numpy as np

from quillon.llm import topk


def brute(rows, k):
    width = max((len(v) for _, v in rows), default=0)
    m = {}
    out = []
    v = [(i, [int(np.floor(64.0 * np.float64(np.float32(x)))) for x in e] + [0] * (width - len(e))) for i, e in rows]
    for q, e in {i: e for i, e in v if i % 20 == 0}.items():
        s = sorted(((-sum(a * b for a, b in zip(e, f)), j) for j, f in v if j != q))[:k]
        out += [(q, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_follows_brute_force_with_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(0, 0.1, 8).astype("f4").tolist()) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(60)] + [(300, [0.1] * 5), (320, [])]
    bad = [(None, [0.1] * 8), (400, None), (401, [0.1, None]), (420, [float("nan")] * 8), (440, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows + bad], "vec_id long, embedding array<float>, score int").repartition(5)
    v = topk.usable(df)
    assert rows_of(topk.search(v, v.where("id % 20 = 0"), 20)) == brute(rows, 20)
    assert topk.search(v.limit(0), v.limit(0), 20).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [1000.0 * i + 0.5, 3e7 + i]) for i in range(0, 45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.usable(df)
    assert rows_of(topk.search(v, v.where("id % 20 = 0"), 5)) == brute(rows, 5)


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(topk.op7_exact_topk(spark, sf)) == brute(rows, 20)


def test_scores_beyond_a_long_are_held_to_its_range(spark):
    rows = [(20, [1e300, 1e300]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [1e307, -1e307]), (4, [0.5, 0.5]), (5, [1e-300, 0.0])]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(v, v.where("id % 20 = 0"), 9).orderBy("rank").collect()
    most = 2**63 - 1
    assert [(r.vec_id, r.score) for r in got] == [(1, most), (4, most), (3, 0), (5, 0), (2, -most)]


def test_blocks_hold_nothing_and_repeated_queries_stay(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(0, 0.2, 8).astype("f4").tolist()) for i in range(400)] + [(40, [0.3] * 8)]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    alive, most = set(), []
    real = topk.common.broadcast_value

    def watched(spark, value):
        b = real(spark, value)
        alive.add(id(b))
        most.append(len(alive))
        end = b.destroy
        b.destroy = lambda: (alive.discard(id(b)), end())
        return b

    monkeypatch.setattr(topk.common, "broadcast_value", watched)
    whole = rows_of(topk.search(v, v.where("id % 20 = 0"), 5))
    one = len(most)
    monkeypatch.setattr(topk, "BLOCK", 4)
    assert rows_of(topk.search(v, v.where("id % 20 = 0"), 5)) == whole
    assert len(most) > 8 * one and max(most) == 2 and not alive
    assert len([r for r in whole if r[0] == 40]) == 10


def test_the_cutoff_saves_work(monkeypatch):
    rnd = np.random.default_rng(6)
    q, v = np.floor(rnd.normal(0, 20, (8, 16))), np.floor(rnd.normal(0, 20, (3000, 16)) * rnd.exponential(1, (3000, 1)))
    score = (q @ v.T).astype(np.int64)
    low = np.sort(score, axis=1)[:, -20]
    done = []
    real = topk._exact
    monkeypatch.setattr(topk, "_exact", lambda a, b: (done.append(len(b)), real(a, b))[1])
    i, j, s = topk.collected(q, v, low)
    assert sorted(zip(i, j, s)) == sorted((a, b, score[a, b]) for a, b in zip(*np.nonzero(score >= low[:, None])))
    assert done[0] == 3000 and done[1] < 2000
