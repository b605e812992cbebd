import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = SEP.findall(text)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(g)
    lines = [x for x in text.split("\n") if SEP.search(x)]
    repeat = len({p for i, x in enumerate(g) if c[x] > 1 for p in range(i, i + 5)})
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), repeat


HARD = [None, "", " \n\n ", "a b c d e f a b c d e", "a\na\n a\na", "x " * 300, "é ß # | <>\r\nq\r\nq", "one two three four five six seven eight nine ten eleven", "\U0001f600 " * 3, "a\x0bb\x0cc " * 4]


def test_counts_follow_python(spark):
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(HARD)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (99, 1, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    for i, t in enumerate(HARD):
        r, want = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, want, r)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(df.limit(0), labels).count() == 0


def test_exact_binomial_bound(spark):
    cases = [(k, n) for n in (0, 5, 300, 1000, 4000, 60000) for k in (0, 1, 2, 5, 9, 20, 400, 520) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("out", quality.refuted(F.col("k"), F.col("n"), 0.01, F.lit(0.003)))
    for r in df.collect():
        tail = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.01) + (r.n - j) * math.log(0.99)) for j in range(r.k + 1))
        assert r.out == (r.n > 0 and tail <= 0.003), (r, tail)


def test_cutoffs_catch_bad_texts_and_keep_good_ones(spark):
    rows = [(i, ("word%d and more text of this kind here again now " % i) + ("%$#" * 25 if i % 10 == 0 else ""), "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    got = quality.judge(df, labels).where("NOT base_failed").collect()
    assert {r.doc_id % 10 == 0 for r in got if not r.kept} == {True} and {r.doc_id % 10 == 0 for r in got if r.kept} == {False}


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_sql_gives_the_same_rows(spark, at):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{at}/{t}.parquet'")
    names = quality.op6_quality_rules(spark, f"/root/testdata/{at}").columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quality.ORACLE})").fetchall()
    assert sorted(map(tuple, quality.op6_quality_rules(spark, f"/root/testdata/{at}").collect())) == sorted(want)
