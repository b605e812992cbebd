import random

import duckdb
from pyspark.sql import functions as F

from quillon.functions import similarity as s


def quadratic(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def words(rnd):
    return "".join(rnd.choice("abcde  ") for _ in range(rnd.randint(0, 24)))


def test_lcs_and_ratio_follow_the_quadratic_programme():
    rnd = random.Random(1)
    for _ in range(1500):
        a, b = words(rnd), words(rnd)
        assert s.lcs(a, b) == quadratic(a, b)
        assert s.ratio(a, b) == (2 * quadratic(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_partial_ratio_is_the_best_window():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = sorted((words(rnd) or "a", words(rnd) or "b"), key=len)
        windows = [b[max(i, 0) : i + len(a)] for i in range(1 - len(a), len(b))]
        best = max(s.ratio(a, w) for w in windows if w)
        if len(a) == len(b):
            best = max(best, max(s.ratio(b, w) for w in (a[max(i, 0) : i + len(b)] for i in range(1 - len(b), len(a))) if w))
        assert abs(s.partial_ratio(a, b) - best) < 1e-12, (a, b)


def test_token_scorers():
    assert s.token_sort_ratio("a b c", "c b a") == 1 and s.token_set_ratio("a b", "a b c d") == 1 and s.token_set_ratio("a a b", "b a") == 1
    assert s.token_set_ratio("x y", "p q") == s.ratio("x y", "p q")
    assert s.weighted_ratio("new york mets", "new york mets") == 1 and s.weighted_ratio("", "a") == 0
    assert 0 < s.weighted_ratio("yankees", "the new york yankees of new york city") <= 0.9


def test_jaro_winkler_follows_duckdb():
    rnd, con = random.Random(3), duckdb.connect()
    for _ in range(300):
        a, b = words(rnd) or "x", words(rnd) or "y"
        want = con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert abs(s.jaro_winkler(a, b) - want) < 1e-9, (a, b)


def test_columns_are_null_without_text(spark):
    df = spark.createDataFrame([("ab", "ab"), ("", "x"), (None, "x"), ("abcde", "abcdx")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(*(s.similarity(k, a, b).alias(k) for k in s.SCORERS), s.exact(a, b).alias("exact"), s.char_jaccard(a, b).alias("cj"), s.common_prefix_share(a, b).alias("cp"), s.length_ratio(a, b).alias("lr"), s.prefix_match(a, b).alias("pm"), s.suffix_match(a, b).alias("sm")).collect()
    assert all(x == 1 for x in rows[0]) and all(x is None for x in rows[1]) and all(x is None for x in rows[2])
    assert rows[3].cp == 0.8 and rows[3].cj == 0.5 and rows[3].pm == 1 and rows[3].sm == 0


def test_sql_names(spark):
    s.register(spark)
    assert spark.sql("SELECT sim_ratio('abc', 'abd') AS x").first().x == 2 * 2 / 6
