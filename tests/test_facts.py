import numpy as np
import pyarrow as pa
import pytest

from quillon import queries
from quillon.functions import text as tx
from quillon.operators import blocking, facts, retrieval
from quillon.sources import records


def test_shared_tokens_of_any_width():
    rnd = np.random.default_rng(0)
    a, b = ([rnd.choice(60, n, replace=False).tolist() for n in rnd.integers(0, 40, 50)] for _ in range(2))
    i, j = rnd.integers(0, 50, 3000), rnd.integers(0, 50, 3000)
    cols = [pa.chunked_array([pa.array(x, pa.list_(pa.int64()))]) for x in (a, b)]
    n, m, both = facts.shared(*cols, i, j)
    assert [*zip(n, m, both)] == [(len(a[p]), len(b[q]), len(set(a[p]) & set(b[q]))) for p, q in zip(i, j)]


@pytest.fixture(scope="module")
def sides(spark):
    words = ["ab", "cd", "and", "12", "3", "x"]
    rows = [(k, " ".join(words[(k * (w + 3) + w) % 6] for w in range(k % 9)) if k % 11 else None, "de" if k % 4 else "fr") for k in range(90)]
    rows += [(k, "and and", "de") for k in range(90, 100)]  # many with equal names
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = records.from_documents(d).withColumn("digest", records.text_digest())
    own = tx.address_views(tx.name_views(own)).cache()
    return own.where("source = 'S1'"), own.where("source <> 'S1'")


@pytest.mark.parametrize("most", [1 << 18, 4])
@pytest.mark.parametrize("block", [1000, 3])
def test_search_finds_all_channels_pairs_with_the_facts_of_joins(spark, sides, monkeypatch, most, block):
    monkeypatch.setattr(retrieval, "MOST_ROWS", most)  # several parts of a country
    channels = [blocking.Channel(c.name, c.kind, c.views, {"max_block": block} if c.kind == "exact" else {"max_df": 12, "top_k": 5}) for c in queries.CHANNELS]
    got = facts.candidates(*sides, channels)
    pairs = blocking.union({c.name: c.run(*sides) for c in channels}, "r").select("q", "r", "mask")
    want = facts.joined(pairs, *(facts.records(d) for d in sides))
    cols = ("q", "r", "mask", *facts.FACTS.gives)
    rows = sorted(map(str, got.select(*cols).collect()))
    assert rows == sorted(map(str, want.select(*cols).collect()))
    assert len(rows) > 100 if block == 1000 else rows


def test_records_do_not_travel_with_pairs(spark, sides):
    plan = facts.candidates(*sides, queries.CHANNELS)._jdf.queryExecution().optimizedPlan().toString()
    assert "__c" not in plan  # no join of pairs with records
