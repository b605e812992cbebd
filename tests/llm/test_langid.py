import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillon.llm import langid


def test_held_out_accuracy_and_folds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    held = [r for r in docs if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges_of_the_input(spark):
    rows = [(1, "the cat sat on the mat", "en", "x"), (4, "le chat est sur la table", "fr", "x"), (5, None, "en", "x"), (6, "", None, "x"), (7, "123 ... !", "fr", "x"), (None, "the dog", None, "x"), (8, "chat " * 30000, None, "x")]
    rows += [(9, "the mat", None, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == 9
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[5] == by[6] == by[7] == ("und", 0.0)
    assert by[8][0] == "fr" and by[9][0] == "en"
    assert langid.identify(df.limit(0)).count() == 0
    nothing = df.withColumn("lang", df.lang.substr(100, 1)).where("lang IS NULL")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} <= {"und"}


def test_mixture_of_two_languages_is_seen():
    rnd = np.random.default_rng(1)
    score = np.log(np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]]))
    codes = np.concatenate((rnd.choice([0, 1], 400, p=[0.7, 0.3]), np.full(50, 2)))
    lang, share = langid.infer(codes, np.array([400, 50]), score)
    assert lang.tolist() == [0, 2] and 0.6 < share[0] < 0.8 and share[1] > 0.99


def test_trigrams_mark_word_ends():
    buckets, at = langid.trigrams(pa.array(["a", "ab", "a"]))
    assert at.tolist() == [0, 1, 3, 4] and buckets[0] == buckets[3] != buckets[1]


def test_shares_of_four_and_more_languages_are_not_rescaled():
    for shares in ((45, 20, 20, 15), (40, 15, 15, 15, 15)):
        k = len(shares)
        score = np.where(np.eye(k, dtype=bool), -1.0, -20.0)  # word i is of language i
        codes = np.repeat(np.arange(k), np.array(shares) * 4)
        lang, part = langid.infer(codes, np.array([len(codes)]), score)
        assert lang[0] == 0 and abs(part[0] - shares[0] / 100) < 0.01


def plain(words, tables):
    """Language and score of one text by a plain loop; tables: of each language the log-likelihood of each word."""
    names = sorted(tables)
    like = [[math.exp(tables[k][w] - max(tables[j][w] for j in names)) for k in names] for w in words]
    like = [[max(x, 1e-12) for x in row] for row in like]

    def step(share):
        joint = [[p * x for p, x in zip(share, row)] for row in like]
        total = [sum(row) for row in joint]
        return [sum(row[k] / t for row, t in zip(joint, total)) / len(words) for k in range(len(names))], sum(map(math.log, total))

    share = [1 / len(names)] * len(names)
    for _ in range(langid.ROUNDS):
        share = [max(x, 1e-9) for x in step(share)[0]]
    single = [sum(tables[k][w] - max(tables[j][w] for j in names) for w in words) for k in names]
    best = max(single)
    lang, kept = single.index(best), None
    order = sorted(range(len(names)), key=lambda k: -share[k])
    for n in range(2, len(names) + 1):
        own = [max(share[k], 1e-12) if k in order[:n] else 0.0 for k in range(len(names))]
        own = step([x / sum(own) for x in own])[0]
        gain = step(own)[1] - (n - 1) * (langid.PENALTY + 0.5 * math.log(len(words)))
        if gain > best:
            best, kept = gain, own
    if kept is None:
        two = sorted(single)[-2:]
        return names[lang], 1 / (1 + math.exp(-min(two[1] - two[0], 40)))
    return names[kept.index(max(kept))], max(kept)


def test_predictions_follow_a_plain_mixture(spark):
    rnd = random.Random(5)
    vocab = {k: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(40)] for k, letters in (("aa", "abcde"), ("bb", "defgh"), ("cc", "ghijk"))}
    rows = [(4 * i + k, " ".join(rnd.choices(vocab[lang], k=rnd.randint(1, 30))), lang) for i in range(20) for k, lang in enumerate(vocab)]
    rows += [(1000 + i, " ".join(rnd.choices(vocab["aa"], k=20) + rnd.choices(vocab["bb"], k=rnd.choice([2, 10, 19]))), None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang:
            own = seen.setdefault(lang, Counter())
            for w in t.split():
                own.update(langid.trigrams(pa.array([w]))[0].tolist())
    log = {k: (lambda b, c=c: math.log((c[b] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * 2**langid.BITS))) for k, c in seen.items()}
    words = {w for _, t, _ in rows for w in t.split()}
    tables = {k: {w: sum(map(f, langid.trigrams(pa.array([w]))[0].tolist())) for w in words} for k, f in log.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    for i, t, _ in rows:
        lang, score = plain(t.split(), tables)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-3


def test_columns_of_the_user_stay(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en", "mine", 7) for i in range(8)] + [(9, "le chat est sur la table", "fr", "mine", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int")
    got = langid.keep_identified(spark, df, "")
    assert got.dtypes == df.dtypes and {(r.score, r.lang_pred) for r in got.collect()} == {("mine", 7)}
