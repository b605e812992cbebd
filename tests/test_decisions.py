import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import analysis, collective, decision, evaluation, features
from quillon.sources import records

def plain_f(true: set, said: set, beta: float = 0.5) -> float:
    """F-beta of two sets; of two empty ones 1."""
    if not true and not said:
        return 1.0
    hit = len(true & said)
    return (1 + beta**2) * hit / (beta**2 * len(true) + len(said)) if hit else 0.0


def test_entities_follow_a_plain_f(spark):
    rnd = random.Random(11)
    ids = [f"S{rnd.choice('23')}-{i}" for i in range(9)]
    truth = {f"e{i}": rnd.sample(ids, rnd.choice([0, 0, 1, 1, 2, 3, 5])) for i in range(80)}
    said = {k: rnd.sample(v, rnd.randint(0, len(v))) + rnd.sample(ids, rnd.choice([0, 0, 1, 2])) for k, v in truth.items() if rnd.random() < 0.9}
    t = spark.createDataFrame(list(truth.items()), "entity_id string, ids array<string>")
    p = spark.createDataFrame([*said.items(), ("elsewhere", ids[:2])], "entity_id string, ids array<string>")  # repeated ids among them
    want = {k: plain_f(set(v), set(said.get(k, ()))) for k, v in truth.items()}
    got = {r.entity_id: r.f for r in evaluation.entity_metrics(p, t).collect()}
    assert got == pytest.approx(want) and len(set(want.values())) > 6
    assert evaluation.macro(evaluation.entity_metrics(p, t)).first().macro_f == pytest.approx(sum(want.values()) / len(want), abs=1e-6)


def test_id_lists(spark):
    rows = spark.createDataFrame([(" a, b ,,c",), (None,), ("",)], "v string").select(evaluation.ids(F.col("v")).alias("x")).collect()
    assert [r.x for r in rows] == [["a", "b", "c"], [], []]


PAIRS = [("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.9), ("S1-1", "S3-1", 0.7), ("S1-2", "S2-1", 0.95), ("S1-2", "S3-9", 0.2), ("S1-3", "S2-5", 0.6)]


def frame(spark):
    return spark.createDataFrame(PAIRS, "q string, r string, p double")


def chosen(df):
    return sorted((r.q, r.r) for r in df.collect())


def test_rules_in_their_order(spark):
    pairs = frame(spark)
    d = lambda **k: chosen(decision.decide(pairs, decision.Params(**k)))
    assert d(t_first=0.5, t_rest=0.8) == [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1"), ("S1-3", "S2-5")]
    assert d(t_first=0.96, t_rest=0.8) == [("S1-1", "S2-2")]  # each pair is tested on its own
    assert d(t_first=0.5, t_rest=0.5, cap_s2=1) == [("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-1"), ("S1-3", "S2-5")]
    assert d(t_first=0.5, t_rest=0.5, cap_s2=1, exclusive=True) == [("S1-1", "S3-1"), ("S1-2", "S2-1"), ("S1-3", "S2-5")]  # S2-2 doesn't move up
    assert d(t_first=0.5, t_rest=0.5, margin_min=0.1) == [("S1-1", "S2-1"), ("S1-2", "S2-1"), ("S1-3", "S2-5")]
    assert d(t_first=0.5, t_rest=0.5, margin_min=0.1, ambiguous="empty") == [("S1-2", "S2-1"), ("S1-3", "S2-5")]
    assert d(t_first=0.5, t_rest=0.5, relative=0.9) == [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1"), ("S1-3", "S2-5")]
    with_country = pairs.withColumn("country_key", F.when(F.col("q") == "S1-3", "fr").otherwise(""))
    assert chosen(decision.decide(with_country, decision.Params(0.9, 0.9, country={"fr": (0.6, 0.6)}))) == [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1"), ("S1-3", "S2-5")]


def test_ties_and_single_candidates(spark):
    r = {(x.q, x.r): x for x in decision.prepare(frame(spark)).collect()}
    assert [r["S1-1", c].rank for c in ("S2-1", "S2-2", "S3-1")] == [0, 1, 2] and r["S1-3", "S2-5"].second == 0 and r["S1-1", "S3-1"].source_rank == 0


def test_grid_agrees_with_single_runs(spark):
    pairs = frame(spark).withColumn("label", (F.col("r") == "S2-1").cast("int"))
    counts = spark.createDataFrame([("S1-1", 1), ("S1-2", 1), ("S1-3", 0), ("S1-4", 0)], "q string, num_truth long")
    ranked = decision.prepare(pairs)
    params = [decision.Params(0.5, 0.8), decision.Params(0.5, 0.5, cap_s2=1, exclusive=True), decision.Params(0.99, 0.99), decision.Params(0.5, 0.5, margin_min=0.1)]
    got = {r.g: r.macro_f05 for r in decision.evaluate_grid(ranked, counts, params).collect()}
    for i, p in enumerate(params):
        want = decision.score(decision.outcomes(decision.select(ranked, p), counts)).first().macro_f05
        assert got[i] == pytest.approx(want, abs=1e-6)
    best, log = decision.tune(ranked, counts.withColumn("country_key", F.lit("")), families=("global", "caps", "exclusive"))
    assert log[-1][1] >= log[0][1] and best.t_first >= 0.5


def test_ownership_shares_a_candidate(spark):
    out = {(r.q, r.r): r.p for r in decision.ownership(frame(spark)).collect()}
    assert out["S1-2", "S2-1"] == pytest.approx(19 / (1 + 9 + 19)) and out["S1-3", "S2-5"] == pytest.approx(0.6)


def test_anchors_leave_the_pair_itself_out(spark):
    pairs = spark.createDataFrame([("S1-1", f"S2-{i}", 0.99 - i / 1000) for i in range(8)] + [("S1-2", "S2-1", 0.5)], "q string, r string, p double")
    ref = spark.createDataFrame([(f"S2-{i}", "n", "n", "a", "s", "1") for i in range(8)], "entity_id string, name_basic string, name_content_compact string, address_basic string, street_core string, street_number string")
    out = {(r.q, r.r): r for r in collective.anchor_agreement(pairs, ref).collect()}
    assert out["S1-1", "S2-0"].n_anchors == 4 and out["S1-1", "S2-7"].n_anchors == 5 and out["S1-2", "S2-1"].n_anchors == 0 and out["S1-2", "S2-1"].anc_p_max is None


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("q"), (F.col("id") % 2).cast("double").alias("v"))
    r = analysis.bootstrap(df, "v", "q", 200).first()
    assert r.p05 < 0.5 < r.p95 and 0.015 < r["std"] < 0.04


def scored(spark, n=60):
    """Pairs with random scores on and beside the thresholds, and the number of true links of every S1."""
    rnd = random.Random(2)
    rows = [(f"S1-{i % 25}", f"S{rnd.choice('23')}-{j}", rnd.choice([0.3, 0.5, 0.55, 0.6, 0.8, 0.9, 0.905, 0.95, rnd.random()]), int(rnd.random() < 0.5), "de" if i % 25 < 9 else "fr") for i in range(n) for j in rnd.sample(range(40), 3)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    pairs = spark.createDataFrame(rows, "q string, r string, p double, label int, country_key string")
    counts = [(f"S1-{i}", sum(r[3] for r in rows if r[0] == f"S1-{i}") + (i % 4 == 0), "de" if i < 9 else "fr") for i in range(28)]
    return pairs, spark.createDataFrame(counts, "q string, num_truth long, country_key string")


def test_sweep_agrees_with_the_grid(spark):
    pairs, counts = scored(spark)
    ranked, counts, values = decision.prepare(pairs), counts.drop("country_key"), (0.5, 0.55, 0.9, 0.902, 0.99, 1.5)
    grid = decision.evaluate_grid(ranked, counts, [decision.Params(v, v) for v in values])
    want = sorted((r.t_first, round(r.macro_f05, 5), r.mean_predicted, r.tp) for r in grid.collect())
    assert sorted((r.threshold, round(r.macro_f05, 5), r.mean_predicted, r.tp) for r in decision.sweep(ranked, counts, values).collect()) == want
    capped = decision.sweep(ranked, counts, values, decision.Params(cap_s2=1)).collect()
    assert len(capped) == len(values) and max(r.tp for r in capped) < max(x[3] for x in want)


def test_tuning_follows_a_plain_search(spark):
    pairs, counts = scored(spark)
    ranked = decision.prepare(pairs).persist()

    def value(params, df=ranked, of=counts):
        return decision.score(decision.outcomes(decision.select(df, params), of.drop("country_key"))).first().macro_f05

    def best(options, *where):
        return max(options, key=lambda p: value(p, *where))  # the first of equals

    want = best([decision.Params(t, t) for t in (0.5, 0.6, 0.9, 0.95)])
    families = ("global", "caps", "country")
    old = decision.GRID, decision.CAPS
    decision.GRID, decision.CAPS = (0.5, 0.6, 0.9, 0.95), ((99, 99), (1, 1))
    try:
        got, log = decision.tune(ranked, counts, families, countries=("de",))
    finally:
        decision.GRID, decision.CAPS = old
    want = best([decision.replace(want, cap_s2=a, cap_s3=a) for a in (99, 1)])
    grid = [decision.replace(want, t_first=a, t_rest=b) for a in (0.5, 0.6, 0.9, 0.95) for b in (0.5, 0.6, 0.9, 0.95) if b >= a and abs(a - want.t_first) <= 0.1 + 1e-9 and abs(b - want.t_rest) <= 0.03 + 1e-9]
    own = best(grid, ranked.where("country_key = 'de'"), counts.where("country_key = 'de'"))
    assert got == decision.replace(want, country={"de": (own.t_first, own.t_rest)}) and [k for k, _ in log] == ["global", "caps", "country de"]
    ranked.unpersist()


def test_pairs_without_a_record_are_an_error(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "x")], "q string, r string")
    one, two = (spark.createDataFrame([(k, 1)], "entity_id string, v int") for k in "ab")
    assert features.paired(pairs.where("r = 'b'"), one, two).count() == 1
    with pytest.raises(Exception, match="no record of the pair a x"):
        features.paired(pairs, one, two).collect()
    with pytest.raises(Exception, match="no row at 9"):
        records.at_positions(two.withColumnRenamed("v", "rid"), spark.createDataFrame([(1, 0), (9, 1)], "rid int, place int")).collect()
