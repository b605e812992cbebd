"""What went wrong, and how much it cost: taxonomies, root causes, subgroups, bootstraps, experiments.

Tables: pairs (q, r, p, label, selected and features), entities (outcomes() and more), truth (q, r, retrieved, selected, p).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW, HIGH = 0.6, 0.9


def _n() -> Column:
    return F.coalesce("name_token_set_ratio", F.lit(0.0))


def _a() -> Column:
    return F.coalesce("address_token_set_ratio", F.lit(0.0))


def evidence_type() -> Column:
    """Why a true pair scored low."""
    return (
        F.when(F.col("address_missing_cand") == 1, "MISSING_DATA").when(F.col("name_cand_non_latin") == 1, "TRANSLITERATION")
        .when((_n() < LOW) & (_a() < LOW), "BOTH_NOISY").when(_n() < LOW, "NAME_NOISE").when(_a() < LOW, "ADDRESS_NOISE")
        .when(F.col("number_conflict") == 1, "NUMBER_NOISE").otherwise("STRONG_EVIDENCE_LOW_SCORE")
    )


def false_negatives(truth: DataFrame, threshold: float) -> DataFrame:
    """Adds stage, component and category to the true pairs that weren't selected."""
    p = F.coalesce("p", F.lit(-1.0))
    stage = F.when(~F.col("retrieved"), "NOT_RETRIEVED").when(p < 0.5, "LOW_MODEL_SCORE").when(p < threshold, "THRESHOLD").otherwise("DECISION_RULE")
    rows = truth.where(~F.col("selected")).withColumn("stage", stage)
    component = F.when(F.col("stage") == "NOT_RETRIEVED", "blocking").when(F.col("stage") == "LOW_MODEL_SCORE", "features/model").when(F.col("stage") == "THRESHOLD", "decision threshold").otherwise("decision rule")
    category = F.when(F.col("stage") == "LOW_MODEL_SCORE", F.concat(F.lit("FN_LOW_MODEL_SCORE:"), evidence_type())).otherwise(F.concat(F.lit("FN_"), "stage"))
    return rows.withColumns({"component": component, "category": category})


def false_positives(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds structure, evidence and category to the selected pairs that are wrong."""
    rows = pairs.where(F.col("selected") & (F.col("label") == 0)).join(entities.select("q", "num_truth", F.col("tp").alias("entity_tp")), "q")
    structure = F.when(F.col("num_truth") == 0, "FP_ON_EMPTY_TRUTH").when(F.col("entity_tp") > 0, "FP_EXTRA_MATCH").otherwise("FP_WRONG_MATCH")
    evidence = F.when((_n() >= HIGH) & (_a() >= HIGH), "NEAR_DUPLICATE").when((_n() >= HIGH) & (_a() < LOW), "NAME_COLLISION").when((_a() >= HIGH) & (_n() < LOW), "ADDRESS_COLLISION").when(F.col("number_first_equal") == 1, "NUMBER_COLLISION").otherwise("WEAK_EVIDENCE")
    rows = rows.withColumns({"structure": structure, "evidence": evidence, "high_confidence": F.col("p") >= 0.99})
    return rows.withColumn("category", F.concat_ws(":", "structure", "evidence"))


def taxonomy(pairs: DataFrame, entities: DataFrame, not_retrieved: DataFrame) -> DataFrame:
    """kind, category, pairs, share of its kind: one ladder for wrong pairs, one for missed ones."""
    e = entities.select("q", "num_truth", F.col("tp").alias("entity_tp"))
    hi_n, hi_a = _n() >= HIGH, _a() >= HIGH
    fp = pairs.where(F.col("selected") & (F.col("label") == 0)).join(e, "q").select(F.lit("false_positive").alias("kind"), (
        F.when(F.col("num_truth") == 0, "FP_ON_EMPTY_TRUTH").when(F.col("entity_tp") > 0, "FP_MULTI_MATCH_OVERPREDICTION").when(hi_n & hi_a, "FP_NEAR_DUPLICATE")
        .when(hi_n, "FP_NAME_COLLISION").when(hi_a, "FP_ADDRESS_COLLISION").when(F.col("p") < 0.95, "FP_LOW_CONFIDENCE").otherwise("FP_OTHER")
    ).alias("category"))
    lo_n, lo_a = _n() < LOW, _a() < LOW
    fn = pairs.where(~F.col("selected") & (F.col("label") == 1)).select(F.lit("false_negative").alias("kind"), (
        F.when(F.col("address_missing_cand") == 1, "FN_MISSING_FIELD").when(F.col("name_cand_non_latin") == 1, "FN_TRANSLITERATION").when(lo_n & lo_a, "FN_BOTH_FIELDS_NOISY")
        .when(lo_n, "FN_NAME_NOISE").when(lo_a, "FN_ADDRESS_NOISE").otherwise("FN_BELOW_THRESHOLD")
    ).alias("category"))
    blocked = not_retrieved.select(F.lit("false_negative").alias("kind"), F.lit("FN_BLOCKING").alias("category"))
    out = fp.unionByName(fn).unionByName(blocked).groupBy("kind", "category").agg(F.count("*").alias("pairs"))
    return out.withColumn("share_of_kind", F.round(F.col("pairs") / F.sum("pairs").over(Window.partitionBy("kind")), 4))


def root_causes(fn: DataFrame, fp: DataFrame, entities: DataFrame) -> DataFrame:
    """kind, cause, component with the loss each explains; an entity's loss is shared equally by its wrong pairs."""
    errors = fn.select("q", F.lit("false_negative").alias("kind"), F.col("category").alias("root_cause"), "component").unionByName(fp.select("q", F.lit("false_positive").alias("kind"), F.col("category").alias("root_cause"), F.lit("features/model + decision").alias("component")))
    counts = errors.groupBy("q").agg(F.count("*").alias("errors"))
    share = entities.join(counts, "q").select("q", ((1 - F.col("f05")) / F.col("errors")).alias("points"))
    total = entities.agg(F.count("*").alias("n"), F.sum(1 - F.col("f05")).alias("loss"))
    out = errors.join(share, "q").groupBy("kind", "root_cause", "component").agg(F.count("*").alias("error_pairs"), F.count_distinct("q").alias("entities"), F.sum("points").alias("f05_points"))
    out = out.crossJoin(F.broadcast(total))
    return out.select("kind", "root_cause", "component", "error_pairs", "entities", F.round("f05_points", 6).alias("f05_points"), F.round(F.col("f05_points") / F.col("n"), 6).alias("macro_f05_gain_if_fixed"), F.round(F.try_divide("f05_points", "loss"), 4).alias("share_of_total_loss"))


def by_component(causes: DataFrame) -> DataFrame:
    return causes.groupBy("component").agg(F.sum("error_pairs").alias("error_pairs"), F.round(F.sum("f05_points"), 5).alias("f05_points"), F.round(F.sum("share_of_total_loss"), 4).alias("share_of_total_loss"))


def verdict(causes: DataFrame) -> DataFrame:
    """The component that costs most."""
    return by_component(causes).agg(F.max_by("component", F.struct("f05_points", "component")).alias("component"))


def subgroups(entities: DataFrame, group: str) -> DataFrame:
    """part, size, means, entities with loss and the share of all loss."""
    loss = 1 - F.col("f05")
    out = entities.groupBy(F.col(group).alias("part")).agg(
        F.count("*").alias("size"), F.round(F.avg("f05"), 6).alias("mean_f05"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg("num_truth"), 6).alias("mean_truth"), F.round(F.avg("n_pred"), 6).alias("mean_predicted"), F.count_if(F.col("f05") < 1).alias("imperfect"), F.sum(loss).alias("loss"),
    )
    return out.withColumn("share_of_loss", F.round(F.try_divide(F.col("loss"), F.sum("loss").over(Window.partitionBy(F.lit(0)))), 4)).withColumn("loss", F.round("loss", 6))


def bucket(c: Column) -> Column:
    return F.when(c.isNull(), "missing").when(c < LOW, "low").when(c < HIGH, "medium").otherwise("high")


def evidence_matrix(pairs: DataFrame) -> DataFrame:
    """name and address buckets with pairs, true pairs, selected pairs and both rates."""
    out = pairs.groupBy(bucket(F.col("name_token_set_ratio")).alias("name"), bucket(F.col("address_token_set_ratio")).alias("address")).agg(F.count("*").alias("pairs"), F.count_if(F.col("label") == 1).alias("true"), F.count_if(F.col("selected")).alias("selected"))
    return out.withColumns({"true_rate": F.round(F.col("true") / F.col("pairs"), 6), "selected_rate": F.round(F.col("selected") / F.col("pairs"), 6)})


MARGIN_BINS = (0.0, 0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)


def by_margin(entities: DataFrame, margin: str = "top_second_margin", bins=MARGIN_BINS) -> DataFrame:
    """bin (its upper end, which belongs to it), entities, mean F0.5 and mean matches; 0 is a bin of its own."""
    of = F.lit(None).cast("double")
    for b in sorted(bins, reverse=True):
        of = F.when(F.col(margin) <= b, F.lit(float(b))).otherwise(of)
    return entities.groupBy(of.alias("bin")).agg(F.count("*").alias("entities"), F.round(F.avg("f05"), 6).alias("mean_f05"), F.round(F.avg("num_truth"), 6).alias("mean_truth"), F.round(F.sum(1 - F.col("f05")), 6).alias("loss"))


def no_match_rates(top: DataFrame, thresholds) -> DataFrame:
    """threshold, rate of entities without truth whose top probability reaches it, and of those with truth."""
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    rows = top.select("num_truth", "top", grid)
    reach = F.col("top") >= F.col("threshold")
    rate = lambda c: F.round(F.try_divide(F.count_if(c & reach), F.count_if(c)), 6)
    return rows.groupBy("threshold").agg(rate(F.col("num_truth") == 0).alias("false_merge_rate"), rate(F.col("num_truth") > 0).alias("matched_rate"))


def best_score_profile(top: DataFrame) -> DataFrame:
    """Quantiles of the top probability by whether the entity has none, one or several true matches."""
    of = F.when(F.col("num_truth") == 0, "none").when(F.col("num_truth") == 1, "one").otherwise("several")
    return top.groupBy(of.alias("truth")).agg(F.count("*").alias("entities"), *(F.percentile("top", F.lit(q)).alias(f"p{round(100 * q):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)))


def correct_profile(entities: DataFrame, columns) -> DataFrame:
    """Medians and means of perfect and other entities."""
    return entities.groupBy((F.col("f05") == 1).alias("perfect")).agg(F.count("*").alias("entities"), *(f for c in columns for f in (F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.round(F.avg(c), 6).alias(f"{c}_mean"))))


def by_source(selected: DataFrame, truth: DataFrame) -> DataFrame:
    """source, tp, fp, precision, recall."""
    of = F.substring("r", 1, 2).alias("source")
    hits = selected.where("selected").groupBy(of).agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    out = truth.groupBy(of).agg(F.count("*").alias("true")).join(hits, "source", "left").fillna(0, ["tp", "fp"])
    return out.select("source", "tp", "fp", "true", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / F.col("true"), 6).alias("recall"))


def separation(pairs: DataFrame) -> DataFrame:
    """Quantiles of p for each label."""
    return pairs.groupBy("label").agg(F.count("*").alias("pairs"), *(F.percentile("p", F.lit(q)).alias(f"p{round(100 * q):02d}") for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)))


def multi_match(entities: DataFrame) -> DataFrame:
    """Entities with two true matches or more: how many were found whole, in part, or not."""
    many = F.col("num_truth") >= 2
    return entities.where(many).agg(F.count("*").alias("entities"), F.count_if(F.col("tp") == F.col("num_truth")).alias("whole"), F.count_if((F.col("tp") > 0) & (F.col("tp") < F.col("num_truth"))).alias("part"), F.count_if(F.col("tp") == 0).alias("none"), F.round(F.avg("f05"), 6).alias("mean_f05"))


def truth_composition(truth: DataFrame) -> DataFrame:
    """The sources that an S1's matches span, and how many S1 have each span."""
    spans = truth.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set(F.substring("r", 1, 2))), "").alias("span"))
    return spans.groupBy("span").agg(F.count("*").alias("entities"))


def dominant(errors: DataFrame, key: str = "q", category: str = "category") -> DataFrame:
    """The most frequent category of each key, the first by name of equals."""
    n = errors.groupBy(key, category).agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), category))).where("k = 1").select(key, category, "n")


def hard_cases(fn: DataFrame, threshold: float, most: int = 50) -> DataFrame:
    """Missed pairs nearest below the threshold, and those with the lowest scores, up to ``most`` of each kind."""
    near = fn.where(F.col("p") < threshold).orderBy(F.desc("p"), "q", "r").limit(most).withColumn("kind", F.lit("near_threshold"))
    far = fn.where(F.col("p").isNotNull()).orderBy("p", "q", "r").limit(most).withColumn("kind", F.lit("lowest_score"))
    none = fn.where(F.col("p").isNull()).orderBy("q", "r").limit(most).withColumn("kind", F.lit("not_retrieved"))
    return near.unionByName(far).unionByName(none)


def hard_negatives(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    return pairs.where(F.col("selected") & (F.col("label") == 0) & (F.col("p") >= least))


def empty_entities(entities: DataFrame, ranked: DataFrame) -> DataFrame:
    """Entities without truth with their best candidate."""
    return entities.where("num_truth = 0").select("q", "n_pred").join(ranked.where("rank = 0").select("q", F.col("r").alias("best_candidate"), "p"), "q", "left")


def bootstrap(df: DataFrame, value: str, key: str, samples: int = 1000, salt: str = "boot") -> DataFrame:
    """median, p05, p95 and deviation of the mean under resampling, by hash-seeded Poisson(1) weights.

    Each row meets every sample once and is summed in place; nothing but one sum for each sample and task is shuffled.
    """
    u = F.pmod(F.xxhash64(F.col(key), F.col("b"), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    # Poisson(1): the cumulative probabilities of 0, 1, 2, ...
    weight, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(1, 12):
        total += term
        weight = weight + (u >= total).cast("int")
        term /= k
    rows = df.select(key, F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("b")).withColumn("w", weight)
    means = rows.groupBy("b").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.05)).alias("p05"), F.percentile("m", F.lit(0.5)).alias("median"), F.percentile("m", F.lit(0.95)).alias("p95"), F.stddev_pop("m").alias("std"))


def compare(base: DataFrame, other: DataFrame, samples: int = 1000) -> DataFrame:
    """Paired comparison of two runs' entities: difference, its bootstrap interval, counts and the verdict."""
    rows = base.select("q", F.col("f05").alias("a"), F.col("tp").alias("a_tp"), F.col("n_pred").alias("a_n")).join(other.select("q", F.col("f05").alias("b"), F.col("tp").alias("b_tp"), F.col("n_pred").alias("b_n")), "q").withColumn("d", F.col("b") - F.col("a"))
    about = rows.agg(
        F.round(F.avg("d"), 6).alias("delta"), F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("degraded"), F.count_if(F.col("d") == 0).alias("unchanged"),
        F.sum((F.col("b_n") - F.col("b_tp")) - (F.col("a_n") - F.col("a_tp"))).alias("fp_change"), F.sum(F.col("a_tp") - F.col("b_tp")).alias("fn_change"),
    )
    out = about.crossJoin(bootstrap(rows, "d", "q", samples).select("p05", "p95"))  # one row each
    return out.withColumn("verdict", F.when(F.col("p05") > 0, "KEEP").when(F.col("delta") <= 0, "REJECT").otherwise("INCONCLUSIVE"))
