"""Entity-level evaluation: precision, recall and F-beta of sets of ids, their breakdowns, and checks of results.

Lists have entity_id and ids (array); an entity without a prediction counts as predicting nothing, entities that the
truth doesn't have are ignored, and repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.decision import f_beta


def ids(value: Column) -> Column:
    """A comma list of ids as an array: trimmed, without empty ones; null is none."""
    return F.filter(F.transform(F.split(tx.as_text(value), ","), lambda x: F.trim(x)), lambda x: x != "")


def to_lists(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, ids (sorted) from q, r; every entity of ``entities`` has a row."""
    lists = pairs.groupBy(F.col("q").alias("entity_id")).agg(F.array_sort(F.collect_set("r")).alias("ids"))
    return entities.select("entity_id").join(lists, "entity_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def to_pairs(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("entity_id").alias("q"), F.explode(F.array_distinct("ids")).alias("r"))


def entity_metrics(predicted: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """entity_id, n_true, n_pred, tp, precision, recall, f of every entity of the truth."""
    empty = F.array().cast("array<string>")
    rows = truth.select("entity_id", F.array_distinct("ids").alias("t")).join(predicted.select("entity_id", F.array_distinct("ids").alias("p")), "entity_id", "left")
    rows = rows.select("entity_id", "t", F.coalesce("p", empty).alias("p")).select("entity_id", F.size("t").alias("n_true"), F.size("p").alias("n_pred"), F.size(F.array_intersect("t", "p")).alias("tp"))
    both = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    part = lambda n: F.when(both, 1.0).otherwise(F.coalesce(F.try_divide("tp", n), F.lit(0.0)))
    rows = rows.withColumns({"precision": part("n_pred"), "recall": part("n_true")})
    return rows.withColumn("f", F.when(both, 1.0).otherwise(f_beta(F.col("precision"), F.col("recall"), beta)))


def macro(entities: DataFrame, *by: str, beta: float = 0.5) -> DataFrame:
    """Macro and micro figures, for each group or over all."""
    tp, t, p = (F.sum(c) for c in ("tp", "n_true", "n_pred"))
    precision, recall = F.coalesce(F.try_divide(tp, p), F.lit(0.0)), F.coalesce(F.try_divide(tp, t), F.lit(0.0))
    return entities.groupBy(*by).agg(
        F.count("*").alias("entities"), F.round(F.avg("f"), 6).alias("macro_f"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(precision, 6).alias("micro_precision"), F.round(recall, 6).alias("micro_recall"), F.round(f_beta(precision, recall, beta), 6).alias("micro_f"),
    )


def breakdown(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Macro F by group (entity_id, group), with and without truth, and ALL, from one pass over grouping sets."""
    rows = entities.join(groups, "entity_id").withColumn("kind", F.when(F.col("n_true") == 0, "singleton").otherwise("matched"))
    out = rows.groupingSets([[F.col("group")], [F.col("kind")], []], "group", "kind").agg(F.count("*").alias("entities"), F.round(F.avg("f"), 6).alias("macro_f"))
    return out.select(F.coalesce("group", "kind", F.lit("ALL")).alias("part"), "entities", "macro_f")


def prediction_issues(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts of repeated ids, ids with a wrong prefix, entities missing and entities too many."""
    own = predicted.agg(F.coalesce(F.sum(F.size("ids") - F.size(F.array_distinct("ids"))), F.lit(0)).alias("duplicate_ids"), F.coalesce(F.sum(F.size(F.filter("ids", lambda x: ~x.rlike("^S[23]-")))), F.lit(0)).alias("bad_prefix"))
    missing = truth.join(predicted, "entity_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = predicted.join(truth, "entity_id", "left_anti").agg(F.count("*").alias("extra"))
    return own.crossJoin(missing).crossJoin(extra)  # one row each


def baselines(truth: DataFrame) -> DataFrame:
    """name, macro_f of simple predictions: the truth, nothing, one correct id, half of the ids, one wrong id more."""
    n = F.size(F.array_distinct("ids"))
    f = lambda p, r: f_beta(p, r)
    one = F.when(n == 0, 1.0).otherwise(f(F.lit(1.0), 1 / F.greatest(n, F.lit(1))))
    half = F.when(n == 0, 1.0).otherwise(f(F.lit(1.0), F.ceil(n / 2) / F.greatest(n, F.lit(1))))
    wrong = F.when(n == 0, 0.0).otherwise(f(n / (n + 1), F.lit(1.0)))
    empty = (n == 0).cast("double")
    cols = {"oracle": F.lit(1.0), "empty": empty, "one_correct": one, "half": half, "one_wrong_more": wrong}
    wide = truth.agg(*(F.round(F.avg(c), 6).alias(k) for k, c in cols.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("macro_f")) for k in cols))).alias("x")).select("x.*")


def output_check(matches: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts of broken rules of a result: rows for each S1, repeated rows and ids, prefixes, matches that are no candidates."""
    both = matches.join(candidates.select("entity_id", F.col("ids").alias("c")), "entity_id", "left")
    return both.agg(
        (F.count("*") - F.count_distinct("entity_id")).alias("repeated_rows"), F.coalesce(F.sum(F.size("ids") - F.size(F.array_distinct("ids"))), F.lit(0)).alias("repeated_ids"),
        F.coalesce(F.sum(F.size(F.filter("ids", lambda x: ~x.rlike("^S[23]-")))), F.lit(0)).alias("bad_prefix"),
        F.coalesce(F.sum(F.size(F.array_except("ids", F.coalesce("c", F.array().cast("array<string>"))))), F.lit(0)).alias("not_candidates"),
    ).crossJoin(entities.join(matches, "entity_id", "left_anti").agg(F.count("*").alias("missing_rows")))


def reproduced(one: DataFrame, other: DataFrame) -> DataFrame:
    """How two sets of scored pairs (q, r, p) differ: pairs of one side only, and the largest difference of p."""
    left = one.select("q", "r").exceptAll(other.select("q", "r")).agg(F.count("*").alias("only_one"))
    right = other.select("q", "r").exceptAll(one.select("q", "r")).agg(F.count("*").alias("only_other"))
    gap = one.join(other.select("q", "r", F.col("p").alias("p_")), ["q", "r"]).agg(F.count("*").alias("both"), F.max(F.abs(F.col("p") - F.col("p_"))).alias("max_difference"))
    return left.crossJoin(right).crossJoin(gap)


def not_idempotent(df: DataFrame, view: str, function) -> DataFrame:
    """Rows whose view changes when it is normalised again."""
    return df.where(F.col(view) != function(F.col(view)))


def raw_preserved(raw: DataFrame, views: DataFrame, columns: dict[str, str], key: str = "entity_id") -> DataFrame:
    """view, changed, rows, missing: raw views that differ from the column of the raw record (null: ''), and records without one."""
    both = raw.select(key, *(F.coalesce(c, F.lit("")).alias(f"__{v}") for v, c in columns.items())).join(views.select(key, *columns).withColumn("__there", F.lit(True)), key, "left")
    gone = F.col("__there").isNull()
    wide = both.agg(F.count("*").alias("rows"), F.count_if(gone).alias("missing"), *(F.count_if(~gone & ~F.col(v).eqNullSafe(F.col(f"__{v}"))).alias(v) for v in columns))
    names = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("changed")) for v in columns)))
    return wide.select(names.alias("x"), "rows", "missing").select("x.view", "x.changed", "rows", "missing")


def nfkc_unstable(df: DataFrame, views: Sequence[str]) -> DataFrame:
    """view, unstable: rows whose view isn't its own NFKC form."""
    wide = df.agg(*(F.count_if(F.col(v) != tx.nfkc(F.col(v))).alias(v) for v in views))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("unstable")) for v in views))).alias("x")).select("x.*")


def label_check(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Positives of labelled pairs against the truth that was retrieved."""
    positive = pairs.where("label = 1").select("q", "r")
    retrieved = truth.join(pairs.select("q", "r"), ["q", "r"], "left_semi").select("q", "r").distinct()
    return positive.agg(F.count("*").alias("positives")).crossJoin(retrieved.agg(F.count("*").alias("retrieved"))).crossJoin(positive.exceptAll(retrieved).agg(F.count("*").alias("not_in_truth")))
