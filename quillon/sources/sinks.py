"""Writers. Spark's committers make parts atomic; a run that is repeated replaces only the countries it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.evaluation import to_lists


def finished(spark: SparkSession, path: str, country: str = "country_key") -> list[str]:
    """The countries whose folders are there, by name ('': the empty one)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not any(s.isDirectory() for s in fs.listStatus(at)):
        return []
    return sorted(r[0] or "" for r in spark.read.parquet(path).select(F.col(country).cast("string")).distinct().collect())


def write_views(df: DataFrame, path: str, country: str = "country_key", resume: bool = False) -> None:
    """Normalised records as zstd Parquet, one folder a country; only the countries of df are replaced.

    With ``resume`` the countries that an earlier run finished stay and aren't made again: a folder appears when its run commits.
    """
    if resume and (done := finished(df.sparkSession, path, country)):
        df = df.where(~F.col(country).isin(done))
    df.repartition(country, F.pmod(F.xxhash64("entity_id"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(country).parquet(path)


def _id_lists(pairs: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    return to_lists(pairs, entities).select(F.col("entity_id").alias("source1_entity_id"), F.array_join("ids", ",").alias(column))


def write_matches(pairs: DataFrame, entities: DataFrame, path: str) -> None:
    """q, r as a tab-separated list file with a row for every entity."""
    _id_lists(pairs, entities, "matched_entity_ids").write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_candidates(pairs: DataFrame, entities: DataFrame, path: str) -> None:
    _id_lists(pairs, entities, "candidate_entity_ids").write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report table in one file, as json or csv."""
    getattr(df.coalesce(1).write.mode("overwrite"), kind)(path, **({"header": True} if kind == "csv" else {}))


def append_columns(pairs: DataFrame, extra: DataFrame, keys=("q", "r")) -> DataFrame:
    """Pairs with further columns that belong to the same keys; pairs without them keep nulls."""
    return pairs.join(extra, list(keys), "left")


def upsert(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A log in which rows with a key of ``rows`` are replaced and the others kept."""
    return log.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
