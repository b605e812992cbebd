"""Profiles of tables: distributions, missing values, duplicates, lengths, quantiles, correlations, separability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import rules
from quillon.functions import text as tx
from quillon.operators import tokens as tk


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, share of all rows."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def group_distribution(df: DataFrame, column: str) -> DataFrame:
    """key (normalised), rows, and the number of its spellings."""
    key = tx.country_key(F.col(column))
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("rows"), F.count_distinct(column).alias("spellings"))


def only_in(one: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Values of one table that the other lacks."""
    return one.select(column).subtract(other.select(column))


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """bin, n: rows between edges, left ends included; empty bins have 0."""
    of = reduce(lambda c, b: F.when(F.col(column) >= b, F.lit(float(b))).otherwise(c), sorted(edges), F.lit(None).cast("double"))
    counted = df.groupBy(of.alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(float(e),) for e in edges], "bin double")
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def quantiles(df: DataFrame, column: str, at: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99), *by: str) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*by).agg(*(F.percentile(column, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in at), F.min(column).alias("min"), F.max(column).alias("max"))


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """One row a key with the number of rows for each value."""
    return df.groupBy(key).pivot(column, list(values)).count().na.fill(0)


def pattern_shares(df: DataFrame, text: str, group: str, patterns: dict[str, str]) -> DataFrame:
    """Share of rows that match each pattern, for each group and ALL, in one rollup."""
    return df.rollup(group).agg(F.count("*").alias("rows"), *(F.round(F.avg(F.col(text).rlike(p).cast("double")), 6).alias(k) for k, p in patterns.items())).select(F.coalesce(group, F.lit("ALL")).alias("part"), "rows", *patterns)


#: What the profiles of names and addresses look for.
PATTERNS = {"digit": "[0-9]", "ampersand": "&", "period": r"\.", "comma": ",", "hyphen": "-", "hash": "#", "non_ascii": r"[^\x00-\x7F]", "upper": "[A-Z]", "url": r"www\.|https?:", "long_number": "[0-9]{4,}", "newline": "\n", "double_space": "  "}


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a cube of two columns, its margins as ALL."""
    out = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g").bitwiseAND(2) != 0, "ALL").otherwise(F.col(a)).alias(a), F.when(F.col("g").bitwiseAND(1) != 0, "ALL").otherwise(F.col(b)).alias(b), "n")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, values, distinct, duplicates and those without regard to case; blank values are left out."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*").where("trim(v) <> ''")
    return rows.groupBy("column").agg(
        F.count("*").alias("n"), F.count_distinct("v").alias("distinct"), (F.count("*") - F.count_distinct("v")).alias("duplicates"),
        (F.count("*") - F.count_distinct(F.lower("v"))).alias("duplicates_any_case"),
    )


def repeated_values(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """The values that occur most often, of those that occur twice."""
    return df.where(F.trim(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "value").limit(most)


def text_stats(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Lengths in characters and words: least, 5 %, median, mean, 95 %, most."""
    rows = df.select(*by, F.length(column).alias("chars"), F.size(tx.tokens(tx.whitespace_normalize(F.col(column)))).alias("words"))
    stats = lambda c: [F.min(c).alias(f"{c}_min"), F.percentile(c, F.lit(0.05)).alias(f"{c}_p05"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.round(F.avg(c), 6).alias(f"{c}_mean"), F.percentile(c, F.lit(0.95)).alias(f"{c}_p95"), F.max(c).alias(f"{c}_max")]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *stats("chars"), *stats("words"))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, nulls, empty, blank, placeholders and placeholders between commas."""
    holds = rules.literal(rules.PLACEHOLDERS)
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    part = lambda v: F.array_contains(holds, F.lower(F.trim(v)))
    return rows.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v") == "").alias("empty"), F.count_if(F.trim("v") == "").alias("blank"),
        F.count_if(part(F.col("v"))).alias("placeholders"), F.count_if(F.exists(F.split("v", ","), part)).alias("components"),
    )


def unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the distinct values of each column."""
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns))


def truth_profile(truth: DataFrame, entities: DataFrame, references: DataFrame) -> DataFrame:
    """One row about true links: counts, singletons, most and mean matches, coverage, references linked more than once."""
    per = entities.select(F.col("entity_id").alias("q")).join(truth.groupBy("q").agg(F.count("*").alias("n")), "q", "left").fillna(0, ["n"])
    linked = truth.groupBy("r").agg(F.count("*").alias("k"))
    missing = linked.join(references.select(F.col("entity_id").alias("r")), "r", "left_anti").agg(F.count("*").alias("missing_references"))
    never = references.select(F.col("entity_id").alias("r")).join(linked, "r", "left_anti").agg(F.count("*").alias("never_linked"))
    about = per.agg(F.count("*").alias("entities"), F.sum("n").alias("links"), F.count_if(F.col("n") == 0).alias("singletons"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))
    return about.crossJoin(linked.agg(F.count_if(F.col("k") > 1).alias("linked_twice"))).crossJoin(missing).crossJoin(never)


def country_conflicts(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Links whose two records differ in country."""
    a = left.select(F.col("entity_id").alias("q"), F.col("country_key").alias("q_country"))
    b = right.select(F.col("entity_id").alias("r"), F.col("country_key").alias("r_country"))
    return truth.join(a, "q").join(b, "r").where("q_country <> r_country").select("q", "r", "q_country", "r_country")


def view_collisions(df: DataFrame, raw: str, view: str, numbers: str) -> DataFrame:
    """How far a view collapses raw values: values, groups, raw values a group at most, groups that join several numbers."""
    per = df.where(F.col(view) != "").groupBy(view).agg(F.count("*").alias("rows"), F.count_distinct(raw).alias("raws"), F.count_distinct(numbers).alias("numbers"))
    return per.agg(F.sum("rows").alias("rows"), F.count("*").alias("values"), F.count_if(F.col("raws") > 1).alias("joined"), F.max("raws").alias("most_raws"), F.count_if(F.col("numbers") > 1).alias("joined_numbers"), F.round(1 - F.count("*") / F.sum("rows"), 6).alias("collapse"))


def script_profile(df: DataFrame, column: str, group: str) -> DataFrame:
    """group, script, n and its share of the group."""
    out = df.groupBy(group, tx.dominant_script(F.col(column)).alias("script")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def view_agreement(truth: DataFrame, left: DataFrame, right: DataFrame, views: Sequence[str]) -> DataFrame:
    """view, pairs, equal: how often true pairs agree in a view; and shared: S1 whose value another S1 has too."""
    a = left.select(F.col("entity_id").alias("q"), *(F.col(v).alias(f"a_{v}") for v in views))
    b = right.select(F.col("entity_id").alias("r"), *(F.col(v).alias(f"b_{v}") for v in views))
    rows = truth.join(a, "q").join(b, "r").agg(F.count("*").alias("pairs"), *(F.count_if((F.col(f"a_{v}") == F.col(f"b_{v}")) & (F.col(f"a_{v}") != "")).alias(v) for v in views))
    equal = rows.select("pairs", F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("equal")) for v in views))).alias("x")).select("x.view", "pairs", "x.equal")
    values = left.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("value")) for v in views))).alias("x")).select("x.*").where("value <> ''")
    shared = values.groupBy("view", "value").agg(F.count("*").alias("k")).groupBy("view").agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("shared"))
    return equal.join(shared, "view", "left").fillna(0, ["shared"])


def token_frequencies(df: DataFrame, view: str, group: str, source: str, min_count: int = 5, top: int = 20) -> DataFrame:
    """group, token, counts in S1 and elsewhere, and how over-represented it is elsewhere; the top tokens of each group."""
    rows = tk.exploded(df, view, "entity_id", group, source)
    sizes = df.groupBy(group).agg(F.count_if(F.col(source) == "S1").alias("n1"), F.count_if(F.col(source) != "S1").alias("n2"))
    out = rows.groupBy(group, "token").agg(F.count_if(F.col(source) == "S1").alias("s1"), F.count_if(F.col(source) != "S1").alias("others")).where(F.col("s1") + F.col("others") >= min_count)
    out = out.join(F.broadcast(sizes), group).withColumn("ratio", F.round(((F.col("others") + 1) / (F.col("n2") + 1)) / ((F.col("s1") + 1) / (F.col("n1") + 1)), 6))
    order = Window.partitionBy(group).orderBy(F.desc("ratio"), F.desc("others"), "token")
    return out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).select(group, "token", "s1", "others", "ratio", "n")


def _long(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(*keep, "x.*")


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, missing and zero shares, distinct values, constant, mean, population deviation, least, most."""
    return _long(df, columns).groupBy("feature").agg(
        F.round(F.avg(F.col("v").isNull().cast("double")), 6).alias("missing"), F.round(F.avg((F.col("v") == 0).cast("double")), 6).alias("zero"), F.count_distinct("v").alias("distinct"), (F.count_distinct("v") <= 1).alias("constant"),
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
    )


def label_profile(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, label, rows, mean, quartiles."""
    return _long(df, columns, label).groupBy("feature", label).agg(F.count("v").alias("rows"), F.round(F.avg("v"), 6).alias("mean"), *(F.percentile("v", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)))


def auc(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, auc, direction: rank-sum area under the ROC curve; missing values rank lowest, ties share their mean rank.

    Equal values are counted before they are ranked, so that the window runs over distinct values.
    """
    rows = _long(df, columns, label).groupBy("feature", F.coalesce("v", F.lit(float("-inf"))).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.select("feature", "n", "pos", (before + (F.col("n") + 1) / 2).alias("rank"))
    sums = ranked.groupBy("feature").agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    area = F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("t") - F.col("p")))
    return sums.select("feature", F.round(area, 6).alias("auc"), F.when(area >= 0.5, "higher").otherwise("lower").alias("direction"))


def correlated_pairs(df: DataFrame, columns: Sequence[str], least: float = 0.95) -> DataFrame:
    """a, b, r of features whose Pearson correlation reaches the limit; missing counts as -1. All sums in one pass."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*(F.try_divide(F.covar_pop(x[a], x[b]), F.stddev_pop(x[a]) * F.stddev_pop(x[b])).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    out = wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{i}"), 6).alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")
    return out.where(F.abs("r") >= least)


def equal_columns(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """a, b of columns that are equal in every row, by an order-free signature of (key, value)."""
    wide = df.agg(*(F.bit_xor(F.xxhash64(F.col(key), F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))).alias(c) for c in columns))
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("s")) for c in columns))).alias("x")).select("x.*")
    other = rows.select(F.col("c").alias("b"), "s")
    return rows.withColumnRenamed("c", "a").join(other, "s").where("a < b").select("a", "b")


def log_loss(df: DataFrame, p: str, label: str) -> DataFrame:
    """Mean logarithmic loss, probabilities clipped at 1e-7."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.agg(F.round(F.avg(-F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q))), 6).alias("log_loss"), F.count("*").alias("rows"))


def examples(df: DataFrame, group: str, key: str, n: int = 5, salt: str = "x") -> DataFrame:
    """n rows of each group, in the order of md5(salt + key)."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key)
    return df.withColumn("example", F.row_number().over(order)).where(F.col("example") <= n)
