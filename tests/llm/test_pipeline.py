import re
import sys

import corpus_pipeline
from quillon.llm import langid, neardup, toxicity

from tests.llm import test_neardup as near
from tests.llm import test_packing as packing
from tests.llm import test_substring as substring

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def test_every_stage_follows_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.common.table(stage(spark, before, sf), f"test-{name}")
        out[name] = before, after
        if name != "packing":
            assert after.schema.simpleString() == docs.schema.simpleString()
            before = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    a, b = out["language_id"]
    judged = langid.identify(a).collect()
    assert ids(b) == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.5}
    assert len(ids(b)) > 0.98 * a.count()

    a, b = out["toxicity"]
    scores = toxicity.predict(a, toxicity.fit(a, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert ids(b) == {r.doc_id for r in scores if r.score < 0.5}

    a, b = out["near_dedup"]
    assert ids(b) == {i for i, (_, _, kept) in near.brute(texts(a), 5, 80).items() if kept}

    a, b = out["substring_dedup"]
    gone = {int(i): n for i, _, n, _ in substring.brute(texts(a))}
    old, new = dict(texts(a)), dict(texts(b))
    assert set(old) == set(new)
    assert all((new[i] == old[i]) if not gone[i] else len(SEP.findall(new[i])) == len(SEP.findall(old[i])) - gone[i] for i in old)
    assert all(r.n_chars == len(r.text) for r in b.collect() if gone[r.doc_id])

    a, b = out["packing"]
    rows = b.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(x for i, t in texts(a) for x in packing.expected(i, t))
    packing.sound(rows, 4096)
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_stages_take_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the and of to in " * 20, None, "s", 1), (2, "the and of to in " * 20, "en", "s", 1), (3, None, "fr", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
            df.collect()


def test_whole_chain_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(bool(re.match(r"op\d+_", n)) for n in names) == 10
    assert "sys" in dir() or sys
