"""Token statistics: document frequencies, inverse document frequencies, learned translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx

#: IDFs are summed as whole numbers of this part, so that sums don't depend on their order.
PART = 1_000_000_000
RARE_DF = 100


def exploded(df: DataFrame, view: str, *keys: str) -> DataFrame:
    """keys, token: the distinct tokens of each row."""
    return df.select(*keys, F.explode(F.array_distinct(tx.tokens(F.col(view)))).alias("token"))


def document_frequency(df: DataFrame, view: str, *by: str) -> DataFrame:
    """by, token, df: the number of rows that hold the token."""
    return exploded(df, view, *by).groupBy(*by, "token").agg(F.count("*").alias("df"))


def idf_blocking(n: Column, df: Column) -> Column:
    """ln(n / df), in whole parts."""
    return F.round(F.log(n / df) * PART).cast("long")


def idf_feature(n: Column, df: Column) -> Column:
    """ln((n + 1) / (df + 1)) + 1, in whole parts."""
    return F.round((F.log((n + 1) / (df + 1)) + 1) * PART).cast("long")


#: Words of a dictionary at most (about 1 MB).
MOST_WORDS = 20_000


def learn_translation(pairs: DataFrame, s1: DataFrame, target: DataFrame, view: str, min_count: int = 5, min_probability: float = 0.5, foreign_ratio: float = 0.05) -> DataFrame:
    """token, translation, probability, support, from aligned true pairs (s1_text, target_text).

    A token is foreign where it is much rarer in s1 than in target. In each pair the foreign tokens of the target are
    counted with the s1 tokens that it lacks; the most frequent partner is the translation, the smallest of equals.
    """
    counts = [document_frequency(d, view).withColumnRenamed("df", name) for d, name in ((target, "target_df"), (s1, "s1_df"))]
    sizes = s1.agg(F.count("*").alias("n_s1")).crossJoin(target.agg(F.count("*").alias("n_target")))  # one row each
    foreign = counts[0].join(counts[1], "token", "left").crossJoin(F.broadcast(sizes)).where(
        (F.col("target_df") >= min_count) & ~F.col("token").rlike(r"^\p{Nd}+$") & (F.coalesce("s1_df", F.lit(0)) / F.col("n_s1") < foreign_ratio * F.col("target_df") / F.col("n_target"))
    ).select("token")
    rows = pairs.withColumn("pair", F.monotonically_increasing_id()).select("pair", F.array_distinct(tx.tokens(F.col("target_text"))).alias("t"), F.array_distinct(tx.tokens(F.col("s1_text"))).alias("s"))
    rows = rows.select(F.explode("t").alias("token"), F.array_except("s", "t").alias("missing")).join(foreign, "token")
    support = rows.groupBy("token").agg(F.count("*").alias("support"))
    met = rows.select("token", F.explode("missing").alias("translation")).groupBy("token", "translation").agg(F.count("*").alias("n"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "translation"))).where("r = 1")
    out = best.join(support, "token").withColumn("probability", F.col("n") / F.col("support"))
    return out.where((F.col("support") >= min_count) & (F.col("probability") >= min_probability)).select("token", "translation", F.round("probability", 4).alias("probability"), "support")


def dictionary(translations: DataFrame) -> dict[str, str]:
    """A learned dictionary as a Python map, for a literal. One of more than ``MOST_WORDS`` is an error: it is too large for a plan."""
    rows = translations.select("token", "translation").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    return {r.token: r.translation for r in rows}
