"""Samples and splits by stable hashes, so that every run and every engine draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.decision import fold

DIFFICULTY = (("hard", 0.8, 0.20), ("medium", 0.5, 0.06), ("easy", None, 0.04))


def digest(key: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt), key.cast("string")))


def unit(key: Column, salt: str) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.conv(F.substring(digest(key, salt), 1, 8), 16, 10).cast("long") / 4294967296


def uniform(df: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(digest(F.col(key), salt), key).limit(n)


def stratified_split(df: DataFrame, key: str, strata: list[str], share: float = 0.2, salt: str = "split") -> DataFrame:
    """Adds held_out: the same share, rounded, of every stratum."""
    w = Window.partitionBy(*strata)
    order = w.orderBy(digest(F.col(key), salt), key)
    return df.withColumn("held_out", F.row_number().over(order) <= F.round(share * F.count("*").over(w)))


def group_split(df: DataFrame, key: str = "q", share: float = 0.1, salt: str = "dev") -> DataFrame:
    """Adds dev: all rows of a key fall on one side."""
    return df.withColumn("dev", unit(F.col(key), salt) < share)


def difficulty(name: Column, address: Column) -> Column:
    """hard, medium or easy, by the better of two similarities of a negative pair."""
    best = F.greatest(F.coalesce(name, F.lit(0.0)), F.coalesce(address, F.lit(0.0)))
    return F.when(best >= DIFFICULTY[0][1], "hard").when(best >= DIFFICULTY[1][1], "medium").otherwise("easy")


def bucket_counts(df: DataFrame, bucket: Column, label: str = "label") -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))


def training_sample(df: DataFrame, key: Column, bucket: Column, label: str = "label", salt: str = "train") -> DataFrame:
    """All positives, and of the negatives of each bucket its share; weight is the inverse of the share."""
    rate = F.when(F.col(label) == 1, 1.0)
    for name, _, share in DIFFICULTY:
        rate = rate.when(bucket == name, share)
    return df.withColumn("rate", rate).where(unit(key, salt) < F.col("rate")).withColumn("weight", 1 / F.col("rate")).drop("rate")


__all__ = ["fold", "digest", "unit", "uniform", "stratified_split", "group_split", "difficulty", "bucket_counts", "training_sample"]
