import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(doc_id, text, tok=Tokenizer.from_file(PATH), capacity=4096):
    ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
    return [(doc_id, k, s, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, s in enumerate(range(0, len(ids), capacity)) for p in (ids[s : s + capacity],)]


def sound(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_bins(spark, monkeypatch):
    rnd = random.Random(5)
    alphabet = "abAB'sSİΣ \n\t.,!<|>19éÉJ̌ß́　\U0001f680K"
    texts = [None, "", "  ", "it's J̌ <|endoftext|> x<|startoftext|>", "word " * 9000, "same", "same", "x\x1cy \x85z", "Ångström Å"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(df, PATH).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(x for i, t in enumerate(texts) for x in expected(i, t))
    sound(got, 4096)
    monkeypatch.setattr(packing, "GROUP", 3)  # many groups of one length
    again = packing.pack(df, PATH).collect()
    assert len(again) == len(got) and sound(again, 4096) == sound(got, 4096)
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sound(packing.pack(nulls, PATH, 8).collect(), 8) >= 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_plan_uses_all_and_few():
    rnd = random.Random(1)
    for _ in range(20):
        capacity = rnd.choice([50, 400])
        h = Counter(min(capacity, int(rnd.expovariate(1 / (capacity / 6))) + 1) for _ in range(2000))
        bins = packing.plan(h, capacity)
        used = Counter()
        for b in bins:
            assert sum(i.length * i.copies for i in b.items) <= capacity
            for i in b.items:
                used[i.length] += i.copies * b.times
        assert used == h
        assert sum(b.times for b in bins) <= math.ceil(sum(n * c for n, c in h.items()) / capacity) * 1.01 + 1


def test_fullest_is_the_best_sum():
    rnd = random.Random(2)
    for _ in range(100):
        lengths = sorted({rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(5)}.items(), reverse=True)
        slack = rnd.randint(0, 60)
        reach = {0}
        for n, c in lengths:
            reach = {r + n * k for r in reach for k in range(c + 1)}
        got = packing.fullest(lengths, slack)
        assert sum(n * c for n, c in got) == max(r for r in reach if r <= slack)
        assert all(c <= dict(lengths)[n] for n, c in got)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = packing.op8_best_fit_packing(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(x for r in docs for x in expected(r.doc_id, r.text))
    assert sound(got, 4096) <= math.ceil(sum(r.length for r in got) / 4096) + 1


SCRIPTS = {"latin": (0x20, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "indic": (0x900, 0x97F), "thai": (0xE00, 0xE7F),
           "punctuation": (0x2000, 0x206F), "currency": (0x20A0, 0x20BF), "letterlike": (0x2100, 0x218F), "arrows": (0x2190, 0x23FF), "symbols": (0x2500, 0x27BF), "kana": (0x3000, 0x30FF),
           "chinese": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF), "wide": (0xFF00, 0xFFEF), "emoji": (0x1F300, 0x1F9FF), "marks": (0x300, 0x36F)}


def test_texts_of_many_scripts(spark):
    rnd = random.Random(9)
    texts = ["“Quoted” – it’s naïve… Привет, МИР! ΟΔΟΣ ὅδε İstanbul ǅ 漢字かな交じり文 한국어 שלום مرحبا ４２ ﬁn é 🚀✈️ 100 €"]
    for name, (a, b) in SCRIPTS.items():
        own = [chr(x) for x in range(a, b + 1)]
        for _ in range(40):
            mixed = own + [" ", "\u3000", "'s", "A", "7", "."] + ([chr(x) for k in rnd.sample(sorted(SCRIPTS), 2) for x in rnd.sample(range(*SCRIPTS[k]), 8)] if rnd.random() < 0.5 else [])
            texts.append("".join(rnd.choice(mixed) for _ in range(rnd.randint(1, 60))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pieces(df, PATH).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(x for i, t in enumerate(texts) for x in expected(i, t))
    fast = df.where(~df.text.rlike(packing.OTHER)).count()
    assert fast > 200


def test_every_plain_character_is_as_the_library_has_it(spark):
    points = [x for a, b in packing.PLAIN for x in range(a, b + 1) if x < 0x4E00 or x > 0xD7A3 or x % 37 == 0]
    texts = [f"a{chr(x)}b {chr(x)}{chr(x)} 1{chr(x)}" for x in points]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.ids_crc32 for r in packing.pieces(df, PATH).collect()}
    wrong = [hex(points[i]) for i, t in enumerate(texts) if got[i] != expected(i, t)[0][4]]
    assert not wrong, wrong


def test_texts_go_whole_and_unsplit_to_the_encoder(spark):
    df = spark.createDataFrame([(1, "it's"), (2, None)], "doc_id long, text string")
    plan = packing.pieces(df, PATH)._jdf.queryExecution().executedPlan().toString().lower()
    assert "mapinarrow" in plan and "regexp" not in plan and "rlike" not in plan


def test_words_are_those_of_the_pattern():
    rnd = random.Random(11)
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    for size in [*range(1, 7)] * 300 + [4000]:
        text = "".join(rnd.choice("''''srtvelmdax7_!é \n ß") for _ in range(size))
        starts, stops, inside = packing.cut(np.array([ord(c) for c in text], np.uint32))
        assert [text[i:j] for i, j in zip(starts, stops)] == pattern.findall(text), text
        assert inside.tolist() == [not c.isspace() for c in text]


def test_a_full_store_keeps_the_words_at_hand():
    own = packing.Words(PATH, True, 6)
    asked, encode, tok = [], own.encode, Tokenizer.from_file(PATH)
    own.encode = lambda words: asked.extend(words) or encode(words)
    for batch in (["alpha", "beta", "gamma"], ["gamma", "beta", "delta", "épsilon"], ["delta", "zeta"], ["beta", "alpha", "zeta", "delta", "eta", "theta", "iota"]):
        starts, sizes, flat = own(batch)
        assert [flat[i : i + n].tolist() for i, n in zip(starts, sizes)] == [tok.encode(w, add_special_tokens=False).ids for w in batch]
    assert asked == ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "alpha", "eta", "theta", "iota"]


def test_long_words_fill_a_store():
    own = packing.Words(PATH, True, 10)
    own(["q" * 900, "short"])
    starts, sizes, flat = own(["short", "other"])
    assert sorted(own.rows) == ["other", "short"] and len(flat) == sizes.sum() < 80
