import json

import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.functions import text as tx
from quillon.operators import blocking, evaluation, features, models
from quillon.operators import tokens as tk
from quillon.plans import linkage
from quillon.sources import records, sinks
from quillon.streaming import linking


def test_tsv_keeps_text_as_it_is(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t"x\t\nS1-2\t\tNULL, b\tIndia\n', encoding="utf-8")
    rows = {r.entity_id: r for r in records.read_tsv(spark, str(tmp_path / "a.tsv")).collect()}
    assert tuple(rows["S1-1"]) == ("S1-1", "NA", '"x', "") and rows["S1-2"].business_name == ""


def test_lists_make_the_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "q string, r string")
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    sinks.write_matches(pairs, entities, str(tmp_path / "m"))
    got = {r.entity_id: r.ids for r in records.read_lists(spark, str(tmp_path / "m")).collect()}
    assert got == {"S1-1": ["S2-1", "S2-2"], "S1-2": []}


def test_views_are_replaced_by_country(spark, tmp_path):
    df = spark.createDataFrame([("S2-1", "a", "fr"), ("S2-2", "b", "us")], "entity_id string, name_basic string, country_key string")
    sinks.write_views(df, str(tmp_path / "v"))
    sinks.write_views(df.where("country_key = 'us'").withColumn("name_basic", F.lit("c")), str(tmp_path / "v"))
    back = records.read_views(spark, str(tmp_path / "v"), ["entity_id", "name_basic"])
    assert {tuple(r) for r in back.collect()} == {("S2-1", "a"), ("S2-2", "c")}
    one = records.read_views(spark, str(tmp_path / "v"), country="fr")
    assert "PartitionFilters: [isnotnull(country_key" in one._jdf.queryExecution().toString() and one.count() == 1


def test_log_upsert_and_report(spark, tmp_path):
    log = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    out = sinks.upsert(log, spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), "id")
    assert {tuple(r) for r in out.collect()} == {("a", 1), ("b", 3), ("c", 4)}
    sinks.write_report(out.orderBy("id"), str(tmp_path / "r"))
    lines = next((tmp_path / "r").glob("*.json")).read_text().split("\n")
    assert [json.loads(x)["v"] for x in lines if x] == [1, 3, 4]


def test_oversize_blocks_are_skipped_whole(spark):
    rows = [(f"S2-{i}", "k", "us") for i in range(5)] + [("S2-9", "u", "us"), ("S2-8", "", "us"), ("S2-7", "u", "fr")]
    ref = spark.createDataFrame(rows, "entity_id string, v string, country_key string")
    q = spark.createDataFrame([("S1-1", "k", "us"), ("S1-2", "u", "us"), ("S1-3", "", "us")], "entity_id string, v string, country_key string")
    found = lambda n: {(r.q, r.r) for r in blocking.exact_block(q, ref, "v", n).collect()}
    assert found(4) == {("S1-2", "S2-9")} and len(found(5)) == 6


def test_fields_of_a_bag_never_cross(spark):
    ref = spark.createDataFrame([("S2-1", "x y", "p", "us"), ("S2-2", "z", "x", "us"), ("S2-3", "z", "q", "us")], "entity_id string, n string, a string, country_key string")
    q = spark.createDataFrame([("S1-1", "x x", "z", "us")], "entity_id string, n string, a string, country_key string")
    assert [(r.r, r["rank"]) for r in blocking.idf_top_k(q, ref, ["n", "a"], 10, 5).collect()] == [("S2-1", 0)]


def test_all_features_and_both_stages(spark, sf):
    a, b = queries.sides(spark, sf)
    s1, ref = tx.street_views(a), tx.street_views(b)
    left, right = features.prepared(s1, ref)
    pairs = blocking.generate(left, right, queries.CHANNELS)
    for version, n in ((1, 110), (2, 117), (3, 123)):
        assert len(features.build(pairs, left, right, version=version).columns) - 2 == n
    score = lambda d: d.select("q", "r", models.rule_score(F.col("name_token_set_ratio"), F.col("address_token_set_ratio"), F.col("name_content_compact_exact"), F.col("name_content_idf_jaccard")).alias("p"))
    scored, matches = linkage.first_stage(s1, ref, score, channels=queries.CHANNELS)
    truth = evaluation.to_lists(queries.truth(spark, sf), s1.select("entity_id"))
    found = evaluation.macro(evaluation.entity_metrics(evaluation.to_lists(matches, s1.select("entity_id")), truth)).first()
    assert found.micro_recall > 0.5 and found.macro_f > 0.7
    again = linkage.second_stage(scored.cache(), s1, ref, lambda d: d.select("q", "r", "p"))
    assert again.count() >= 1


def test_models_learn_and_calibrate(spark):
    df = spark.range(600).select(F.concat(F.lit("S1-"), F.col("id") % 100).alias("q"), F.concat(F.lit("S2-"), "id").alias("r"), ((F.col("id") * 7 % 100) / 100).alias("name_x"), F.lit(1.0).alias("flat"), F.when(F.col("id") % 3 == 0, F.lit(0.5)).alias("address_y"))
    df = df.withColumn("label", (F.col("name_x") > 0.6).cast("int"))
    cols = models.not_constant(df, models.feature_columns(df))
    assert cols == ["name_x", "address_y"] and models.select_groups(cols, ["name"]) == ["name_x"]
    out = models.predict(df, cols, models.fit(df, cols, [models.boosted(cols, trees=4, depth=3), models.forest(cols, trees=5, depth=3)]))
    assert out.where("(p >= 0.5) = (label = 1)").count() > 560
    for method in ("isotonic", "platt"):
        r = models.Calibrator(method).fit(out).transform(out).agg(F.min("calibrated"), F.max("calibrated")).first()
        assert 0 <= r[0] < 0.1 and 0.9 < r[1] <= 1
    assert models.importance(models.fit(df, cols, [models.forest(cols, trees=5)])[0], cols)[0][0] == "name_x"
    hard = models.hard_examples(df, cols)
    assert models.with_hard_examples(df.withColumn("weight", F.lit(1.0)), hard).count() == 600


def test_stream_links_every_new_record_once(spark, tmp_path):
    ref = tx.normalized(spark.createDataFrame([("S2-1", "Acme Ltd", "", "us"), ("S2-2", "Other", "", "us")], "entity_id string, business_name string, business_address string, country string"))
    schema = records.schema(records.RECORD)
    for n, name in enumerate(("ACME", "other")):
        spark.createDataFrame([(f"S1-{n}", name, "", "US")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        linking.link_stream(stream, ref, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.q, r.r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("S1-0", "S2-1"), ("S1-1", "S2-2")}


def test_char_ngrams_follow_a_plain_cosine(spark):
    import math
    import random

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6)))
    q = {f"S1-{i}": " ".join(word() for _ in range(3)) for i in range(12)}
    r = {f"S2-{i}": " ".join(word() for _ in range(3)) for i in range(20)}

    def bag(text):
        out = {}
        for w in text.split(" "):
            for n in (3, 4):
                for i in range(len(w) + 2 - n + 1):
                    g = f" {w} "[i : i + n]
                    out[g] = out.get(g, 0) + 1
        return out

    bags = {k: bag(v) for k, v in (q | r).items()}
    df = {}
    for k in r:
        for g in bags[k]:
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(r)) / (1 + n)) + 1 for g, n in df.items() if 2 <= n <= 15}

    def vector(k):
        v = {g: (1 + math.log(n)) * idf[g] for g, n in bags[k].items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    vec = {k: vector(k) for k in bags}
    want = {(a, b): s for a in q for b in r if (s := sum(x * vec[b].get(g, 0) for g, x in vec[a].items())) > 0}
    frame = lambda d: spark.createDataFrame([(k, v, "us") for k, v in d.items()], "entity_id string, n string, country_key string")
    got = {(x.q, x.r): x.score / 1e12 for x in blocking.char_top_k(frame(q), frame(r), "n", max_df=15, top_k=50).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    best = {x.q: x.r for x in blocking.char_top_k(frame(q), frame(r), "n", max_df=15, top_k=1).collect()}
    assert all(got[a, b] == max(s for (x, _), s in got.items() if x == a) for a, b in best.items())


def test_translation_and_deleeting_find_candidates(spark):
    """S1-90 and S2-90 share a token only after translation, S1-91 and S2-91 only after de-leeting."""
    s1 = [(f"S1-{i}", f"alpha{i} house", "road") for i in range(6)] + [("S1-90", "house", ""), ("S1-91", "golden", "")]
    ref = [(f"S2-{i}", f"alpha{i} maison", "road") for i in range(6)] + [("S2-90", "maison", ""), ("S2-91", "g0lden", "")] + [(f"S2-{i}", f"other{i}", f"street{i}") for i in range(20, 60)]
    rows = lambda x: tx.address_views(tx.name_views(spark.createDataFrame([(*r, "us", "us", "us") for r in x], "entity_id string, business_name string, business_address string, country_key string, country_raw string, country string")))
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(6)], "q string, r string")
    left, right = rows(s1).persist(), rows(ref).persist()
    channels = [c for c in blocking.FINAL_CHANNELS if c.kind == "tokens"]
    pairs = linkage.candidates(*features.prepared(left, right, *linkage.learn_dictionaries(left, right, truth)), channels)
    found = {(r.q, r.r) for r in pairs.select("q", "r").collect()}
    assert ("S1-90", "S2-90") in found and ("S1-91", "S2-91") in found


def test_character_channel_options(spark):
    ref = spark.createDataFrame([("S2-1", "golden bell", "", "us"), ("S2-2", "golden bell", "x", "us"), ("S2-3", "g0lden b3ll", "", "us")], "entity_id string, n string, address_basic string, country_key string")
    q = spark.createDataFrame([("S1-1", "golden bell", "", "us")], "entity_id string, n string, address_basic string, country_key string")
    found = lambda **k: {x.r for x in blocking.char_top_k(q, ref, "n", min_df=1, **k).collect()}
    top = lambda **k: blocking.char_top_k(q, ref, "n", min_df=1, **k).where("r = 'S2-3'").first().score
    assert found() == {"S2-1", "S2-2", "S2-3"} and found(only_empty_address=True) == {"S2-1", "S2-3"}
    assert top(deleet_reference=True) > top()


def test_models_can_be_saved_and_compared(spark, tmp_path):
    rows = [(f"S1-{i}", f"S2-{i}", (i % 7) / 7, (i * 3 % 11) / 11, int(i % 7 + (i * 3 % 11) / 11 > 3.5), 1.0 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "q string, r string, name_x double, address_x double, label int, weight double")
    cols = ["name_x", "address_x"]
    fitted = models.fit(df, cols, [models.boosted(cols, trees=3, depth=2), models.boosted_sampled(cols, trees=3, depth=3)])
    models.save(fitted, cols, str(tmp_path / "m"))
    loaded, names = models.load(spark, str(tmp_path / "m"))
    score = lambda m: sorted((r.q, r.p) for r in models.predict(df, names, m).collect())
    assert names == cols and score(loaded) == score(fitted)
    out = {r.experiment: r for r in models.experiments(df, df, cols, ("M001_all_weighted", "M003_name_only", "M007_all_weighted_isotonic", "M008_sampled_all_weighted"), trees=4, depth=2).collect()}
    assert out["M003_name_only"].features == 1 and out["M001_all_weighted"].features == 2 and all(r.auc > 0.9 and r.log_loss < 0.7 for r in out.values()) and len(out) == 4


def test_a_run_that_is_resumed_leaves_finished_countries(spark, tmp_path):
    path = str(tmp_path / "views")
    rows = lambda *x: spark.createDataFrame(list(x), "entity_id string, v string, country_key string")
    sinks.write_views(rows(("a", "old", "fr")), path, resume=True)
    sinks.write_views(rows(("a", "new", "fr"), ("b", "new", "us")), path, resume=True)
    assert sorted((r.entity_id, r.v, r.country_key) for r in spark.read.parquet(path).collect()) == [("a", "old", "fr"), ("b", "new", "us")]
    assert sinks.finished(spark, path) == ["fr", "us"] and sinks.finished(spark, str(tmp_path / "none")) == []


def test_audits_of_views(spark):
    raw = spark.createDataFrame([("a", "x"), ("b", None), ("c", "ﬁn"), ("d", "gone")], "entity_id string, n string")
    views = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "other")], "entity_id string, raw string")
    assert evaluation.raw_preserved(raw, views, {"raw": "n"}).collect()[0].asDict() == {"view": "raw", "changed": 1, "rows": 4, "missing": 1}
    both = raw.withColumn("n2", tx.nfkc(F.col("n")))
    assert {r.view: r.unstable for r in evaluation.nfkc_unstable(both, ["n", "n2"]).collect()} == {"n": 1, "n2": 0}


def test_dictionaries_are_bounded(spark, monkeypatch):
    words = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(5)], "token string, translation string")
    assert len(tk.dictionary(words)) == 5
    monkeypatch.setattr(tk, "MOST_WORDS", 4)
    with pytest.raises(ValueError):
        tk.dictionary(words)


def test_blocks_and_tokens_over_their_limit_are_left_out_whole(spark):
    rows = lambda d: spark.createDataFrame([(k, v, "us") for k, v in d.items()], "entity_id string, n string, country_key string")
    q = rows({"S1-1": "7 oak", "S1-2": "8 elm", "S1-3": ""})
    r = rows({"S2-1": "7 oak", "S2-2": "7 oak", "S2-3": "7 oak", "S2-4": "8 elm", "S2-5": "8 elm", "S2-6": "9 elm", "S2-7": ""})
    pairs = lambda df: sorted((x.q, x.r) for x in df.select("q", "r").collect())
    elm = [("S1-2", "S2-4"), ("S1-2", "S2-5")]
    oak = [("S1-1", f"S2-{i}") for i in (1, 2, 3)]
    assert pairs(blocking.exact_block(q, r, "n", 2)) == elm and pairs(blocking.exact_block(q, r, "n", 3)) == oak + elm
    assert pairs(blocking.number_block(q, r, "n", 2)) == elm and pairs(blocking.number_block(q, r, "n", 3))[:3] == oak
    assert pairs(blocking.idf_top_k(q, r, ["n"], max_df=2)) == elm
    assert pairs(blocking.idf_top_k(q, r, ["n"], max_df=3, top_k=1)) == [("S1-1", "S2-1"), ("S1-2", "S2-4")]
