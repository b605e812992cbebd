import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from quillon.llm import toxicity as t


def test_held_out_marks(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in t.op5_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for r in labels if got[r.doc_id].held_out]
    y, p = np.array([r.toxic for r in held]), np.array([got[r.doc_id].score for r in held])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert auc > 0.93 and (p[y == 1] >= 0.5).mean() > 0.85
    assert (p[y == 0] >= 0.5).mean() < 0.02


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(1, "x y", 0), (2, None, 0), (3, "", 0), (None, "z", 0), (4, "q", 0), (4, "q", 0)], "doc_id long, text string, positive int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    w = t.fit(docs, none)
    got = t.predict(docs, w).collect()
    assert len(got) == 6 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, 1), (99, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    assert len(t.predict(docs, t.fit(docs, odd)).collect()) == 6
    assert t.predict(docs.limit(0), w).count() == 0


def test_risk_on_negatives_does_not_pull_unlabelled_positives_down():
    rnd = np.random.default_rng(0)
    rows = [np.array([5, *rnd.integers(100, 200, 3)]) for _ in range(50)] + [np.array([5] * (i < 60) + list(rnd.integers(100, 200, 3))) for i in range(600)]
    positive = np.arange(650) < 50
    chosen = t.select([np.unique(r) for r in rows], positive)
    w, bias = t.nn_pu([np.unique(r) for r in rows], positive, 0.1, chosen)
    assert chosen.tolist() == [5] and w[0] + bias > 0 > bias


def plain_weights(texts, positive, prior):
    """The risk's minimiser, by the same steps, with dictionaries and loops over rows."""
    def feats(text):
        held = {}
        for w in set(re.findall(r"[^\W\d_]+", text.lower())):
            for b in t.word_features(pa.array([w]))[0]:
                if b >= 0:
                    held[int(b)] = held.get(int(b), 0) + 1
        return {b + (k << t.BITS) for b, n in held.items() for k in range(min(n, t.LEVELS))}

    rows = {(frozenset(feats(x)), p) for x, p in zip(texts, positive)}
    pos, unl = ([sorted(r) for r, p in rows if p is k] for k in (True, False))
    chosen = []
    for f in sorted({f for r in pos for f in r}):
        x, y = sum(f in r for r in pos), sum(f in r for r in unl)
        both = (x + y + 1) / (len(pos) + len(unl) + 2)
        if x >= t.LEAST_POSITIVE and (x / len(pos) - y / len(unl)) / math.sqrt(both * (1 - both) * (1 / len(pos) + 1 / len(unl))) >= t.LEAST_Z:
            chosen.append(f)
    w, m, v = ({f: 0.0 for f in [*chosen, -1]} for _ in range(3))
    w[-1] = math.log(prior / (1 - prior))
    score = lambda r: w[-1] + sum(w[f] for f in r if f in w)
    for n in range(1, t.STEPS + 1):
        sp, su = [score(r) for r in pos], [score(r) for r in unl]
        soft = lambda s: max(s, 0) + math.log1p(math.exp(-abs(s)))
        risk = sum(map(soft, su)) / len(su) - prior * sum(map(soft, sp)) / len(sp)
        g = {f: (t.RIDGE * w[f] * prior if f >= 0 else 0.0) for f in w}
        for rows_, scores, kind in ((pos, sp, 1), (unl, su, 0)):
            for r, s in zip(rows_, scores):
                p = 1 / (1 + math.exp(-s))
                minus = -prior * p / len(pos) if kind else p / len(unl)
                plus = -prior * (1 - p) / len(pos) if kind else 0.0
                x = plus + minus if risk >= 0 else -minus
                for f in [*(f for f in r if f in w), -1]:
                    g[f] += x
        for f in w:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.999 * v[f] + 0.001 * g[f] ** 2
            w[f] -= t.RATE * (m[f] / (1 - 0.9**n)) / (math.sqrt(v[f] / (1 - 0.999**n)) + 1e-8)
    return lambda text: 1 / (1 + math.exp(-(w[-1] + sum(w[f] for f in feats(text) if f in w))))


def test_scores_follow_a_plain_fit(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = [(i, " ".join([*rnd.choices(vocab, k=6), *(["vilest", "scumbag"] if i % 3 == 0 else [])])) for i in range(240)] + [(500, None), (501, "")]
    marks = [(i, 1, int(i % 6 == 0)) for i, _ in rows[:240:2]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in t.predict(docs, t.fit(docs, labels)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    toxic = {i for i, _, x in marks if x and not held(i)}
    share = sum(x for i, _, x in marks if not held(i)) / sum(not held(i) for i, _, x in marks)
    learn = [(x or "", i in toxic) for i, x in rows if not held(i)]
    score = plain_weights([x for x, _ in learn], [p for _, p in learn], min(max(share, 1e-3), 0.5))
    assert max(got.values()) > 0.5 > min(got.values())
    assert all(abs(got[i] - score(x or "")) < 1e-6 for i, x in rows)


def test_columns_of_the_user_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'mine' AS score", "CAST('mine' AS BINARY) AS predicted")
    got = t.drop_toxic(spark, docs, sf)
    assert got.dtypes == docs.dtypes and {r.score for r in got.select("score").collect()} == {"mine"}
