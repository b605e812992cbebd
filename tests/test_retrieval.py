import itertools
import math
import random
from collections import Counter

import pytest

from quillon.operators import blocking, retrieval


def most_rows(df):
    """Rows of the result, and the most that an operator of the plan that gave it made."""
    rows = df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        made = node.metrics().get("numOutputRows")
        children = node.children()
        return max([made.get().value() if made.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def records(spark, seed, n, prefix, words, size):
    rng = random.Random(seed)
    rows = [(f"{prefix}-{i}", rng.choice("ab"), " ".join(["all"] * (i > 0) + rng.choices(words, k=rng.randrange(size)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "entity_id string, country_key string, view string")


def brute(left, right, k, max_df=50_000):
    n = Counter(c for _, c, _ in right)
    df = Counter((c, t) for _, c, v in right for t in set(v.split()))
    out = []
    for (q, c, v) in left:
        scores = []
        for r, d, x in right:
            if c == d and (s := sum(round(math.log(n[c] / df[c, t]) * 1e9) for t in set(v.split()) & set(x.split()) if df[c, t] <= max_df)) > 0:
                scores.append((-s, r))
        out += [(q, r, -s, i) for i, (s, r) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("part", [1 << 18, 50])
def test_search_makes_no_row_for_a_shared_token(spark, monkeypatch, part):
    monkeypatch.setattr(retrieval, "MOST_ROWS", part)
    words = [f"w{i}" for i in range(40)]
    left, queries = records(spark, 1, 150, "S1", words, 6)
    right, reference = records(spark, 2, 300, "S2", words, 6)
    df = blocking.idf_top_k(queries, reference, ["view"], top_k=5)
    rows, most = most_rows(df)
    assert sorted((r.q, r.r, r.score, r["rank"]) for r in rows) == brute(left, right, 5)
    hits = sum(a[1] == b[1] for a, b in itertools.product(left, right))
    assert hits > 20_000 and most < 10_000  # a join makes at least a row for each pair that shares "all"


def test_frequent_tokens_are_left_out_and_ties_go_to_the_smaller_id(spark):
    left, queries = records(spark, 3, 60, "S1", ["x", "y", "z"], 4)
    right, reference = records(spark, 4, 200, "S2", ["x", "y", "z"], 4)
    rows = blocking.idf_top_k(queries, reference, ["view"], max_df=70, top_k=7).collect()
    assert sorted((r.q, r.r, r.score, r["rank"]) for r in rows) == brute(left, right, 7, 70)


def test_character_search_makes_no_row_for_a_shared_ngram(spark):
    _, queries = records(spark, 5, 100, "S1", ["stone", "river", "brook"], 3)
    _, reference = records(spark, 6, 200, "S2", ["stones", "rivers", "brook"], 3)
    rows, most = most_rows(blocking.char_top_k(queries, reference, "view", top_k=4))
    ranks = {}
    for r in rows:
        ranks.setdefault(r.q, []).append((r["rank"], -r.score, r.r))
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in ranks.values())
    assert max(map(len, ranks.values())) == 4 and most < 6_000  # a join makes at least 20,000: all pairs of a country share "all"
