import math
import re
import zlib
from collections import Counter

import numpy as np

from quillon.llm import lmscore

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def parts(text):
    return SEP.findall((text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]


def brute(rows):
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in parts(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(rows, held):
        w = parts(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) if n else 0.0
        out.append((str(i), h, len(w), sum(c[x] > 0 for x in w), n, round(base, 4)))
    return sorted(out)


def check(df, rows):
    r = df.collect()
    got = sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in r)
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-4
    return r


def test_base_of_odd_texts(spark, monkeypatch):
    rows = [(i, " ".join(f"W{(i * j) % 40}" for j in range(i % 13))) for i in range(60)] + [(100, None), (101, ""), (102, "\n \t"), (None, "w1 w2"), (103, "x"), (103, "x"), (104, "É é \x1c")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, gram string")
    check(lmscore.score(df, lmscore.common.fold("doc_id", 10) == 0), rows)
    monkeypatch.setattr(lmscore, "MOST_WORDS", 5)  # most words meet their counts in the join
    check(lmscore.score(df, lmscore.common.fold("doc_id", 10) == 0), rows)
    assert lmscore.score(df.limit(0), lmscore.common.fold("doc_id", 10) == 0).count() == 0
    one = df.where("doc_id IS NULL")
    assert [r.base_score for r in lmscore.score(one, lmscore.common.fold("doc_id", 10) == 0).collect()] == [0.0]


def test_filter_never_counts_too_low_and_seldom_too_high():
    rnd = np.random.default_rng(0)
    grams, counts = lmscore.common.mix(np.arange(20000)), rnd.zipf(1.5, 20000).clip(1, 10**6)
    bits, size = 2, 1 << 17
    bucket = (grams >> np.uint64(62)).astype(int)
    data = np.concatenate([lmscore.stretch(grams[bucket == k], lmscore.quantised(counts[bucket == k]), 1, size) for k in range(4)])
    f = lmscore.Filter(bits, size, np.concatenate((data, data)))
    q = f._probe(bucket, grams, 1)
    assert (q >= lmscore.quantised(counts)).all() and (q > lmscore.quantised(counts)).mean() < 0.08
    other = lmscore.common.mix(np.arange(10**6, 10**6 + 20000))
    assert (f.words(other) > 0).mean() < 0.08


def test_model_beats_the_base_on_held_out_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    r = check(lmscore.op10_lm_score(spark, "/root/testdata/sf0.01"), rows)
    held = [x for x in r if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert all(x.score < 0 for x in r)


def exact_scores(rows):
    """Scores with exact counts, quantised as the filter's are: what scores are without a false positive."""
    count = lambda c: 0.0 if not c else 1.0 if c == 1 else 1.4 * 2.0 ** (c.bit_length() - 1)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [["\n", *parts(t)] for _, t in rows]
    one = Counter(w for t, h in zip(texts, held) if not h for w in t[1:])
    two = Counter(x for t, h in zip(texts, held) if not h for x in zip([None, *t[1:]], t[1:]))
    n, v, out = sum(one.values()), len(one), []
    for t in texts:
        total = 0.0
        for k in range(1, len(t)):
            x = (t[k - 1] if k > 1 else None, t[k])
            before, word = count(one[t[k - 1]]), count(one[t[k]])
            both = min(count(two[x]), before, word)
            share = lmscore.WEIGHT * before / (before + lmscore.HALF)
            p = share * both / max(before, 1) + (1 - share) * (word + lmscore.ADD) / (n + lmscore.ADD * (v + 1))
            total += math.log10(min(p, 1))
        out.append(total)
    return out


def zipf_rows(n):
    rnd = np.random.default_rng(1)
    return [(i, " ".join(f"w{x}" for x in rnd.zipf(1.3, 60).clip(1, 5000))) for i in range(n)]


def test_filter_has_the_same_bits_a_token_at_every_size(spark, monkeypatch):
    for letters in (1e6, 2e8, 5e9, 1e12):
        bits, size = lmscore.shape(letters)
        assert size << (bits + 1) >= lmscore.BITS_PER_TOKEN * letters and size <= 1 << 22
    monkeypatch.setattr(lmscore, "MOST_BITS", 12, raising=False)  # no cap holds any more
    monkeypatch.setattr(lmscore, "HELD", 1 << 14)  # many chunks
    monkeypatch.setattr(lmscore, "BUCKET", 1 << 10)  # many buckets
    rows = zipf_rows(400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.score(df, lmscore.common.fold("doc_id", 10) == 0).collect()}
    off = [abs(got[i] - s) for (i, _), s in zip(rows, exact_scores(rows))]
    assert np.median(off) < 0.5


def test_pairs_that_occur_once_count(spark):
    rows = zipf_rows(400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.score(df, lmscore.common.fold("doc_id", 10) == 0).collect()}
    off = [abs(got[i] - s) for (i, _), s in zip(rows, exact_scores(rows))]
    assert np.median(off) < 0.05 and max(off) < 2


def test_training_tokens_are_counted():
    rnd = np.random.default_rng(4)
    texts = ["", " ", "a", " a b\t", "x\x0b\x0cy\x1cz é", *("".join(rnd.choice(list("ab \n\t"), 30)) for _ in range(50))]
    held = rnd.random(len(texts)) < 0.3
    array = lmscore.pa.array(["cut off", *texts])[1:]
    assert lmscore.training_tokens(array, held) == sum(len(parts(t)) for t, h in zip(texts, held) if not h)


def test_very_long_text(spark):
    rows = [(1, "w " * 400_000), (2, None), (10, "w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(lmscore.score(df, lmscore.common.fold("doc_id", 10) == 0), rows)
