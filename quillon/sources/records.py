"""Readers of the tables that the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.functions import text as tx
from quillon.operators.evaluation import ids

RECORD = ("entity_id", "business_name", "business_address", "country")


#: A table under so many bytes a core that lies in few files is dealt out before work starts.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out to all cores; any other as it is.

    A Parquet row group is read by one task, so a small table of one file would keep all but one core idle.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))
    return df.repartition(cores) if size < SMALL * cores else df


def schema(columns) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns=RECORD) -> DataFrame:
    """A tab-separated file of strings with a header: no quoting, NA and NULL are text, an empty field is ''.

    The header must name the columns in their order, or the read fails.
    """
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema=schema(columns), enforceSchema=False, mode="FAILFAST", multiLine=False)
    return df.select(*(tx.as_text(F.col(c)).alias(c) for c in columns))


def read_lists(spark: SparkSession, path: str, key: str = "source1_entity_id", values: str = "matched_entity_ids") -> DataFrame:
    """entity_id, ids of a tab-separated file with a comma list in its second column."""
    df = read_tsv(spark, path, (key, values))
    return df.select(F.col(key).alias("entity_id"), ids(F.col(values)).alias("ids"))


def read_views(spark: SparkSession, path: str, views=None, country: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Normalised records: named columns, one country (partitions and row groups are pruned), the ids of ``only``."""
    df = spark.read.parquet(path)
    if country is not None:
        df = df.where(F.col("country_key") == country)
    if only is not None:
        df = df.join(only.select("entity_id").distinct(), "entity_id", "left_semi")
    return df.select(*views) if views else df


def read_predictions(spark: SparkSession, path: str, floor: float = 0.0) -> DataFrame:
    """Scored pairs of at least the floor; the filter reaches the files."""
    return spark.read.parquet(path).where(F.col("p") >= floor)


def check_ids(df: DataFrame, prefix: str, key: str = "entity_id") -> DataFrame:
    """Rows, repeated ids, ids with another prefix, null or empty ids."""
    return df.agg(F.count("*").alias("rows"), (F.count(key) - F.count_distinct(key)).alias("repeated"), F.count_if(~F.coalesce(F.col(key), F.lit("")).startswith(prefix)).alias("bad_prefix"), F.count_if(F.coalesce(F.col(key), F.lit("")) == "").alias("empty"))


def at_positions(df: DataFrame, positions: DataFrame, key: str = "rid") -> DataFrame:
    """The rows of the given positions, with their place in the order asked for; a position without a row is an error."""
    found = positions.join(df.withColumn("__found", F.lit(True)), key, "left")
    return found.where(F.assert_true(F.col("__found"), F.concat(F.lit("no row at "), F.col(key).cast("string"))).isNull()).drop("__found")


def from_documents(docs: DataFrame) -> DataFrame:
    """Records made from documents: the words of a text give the name (1 to 5) and the address (6 to 15), doc_id the
    source, lang the country; ``basic`` is the whole text's words."""
    words = F.trim(F.regexp_replace(F.lower("text"), tx.NON_WORD, " "))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("country_key"), F.coalesce(words, F.lit("")).alias("basic"))
    source = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    tk = F.split("basic", " ")
    rows = rows.select(F.concat_ws("-", source, F.col("doc_id").cast("string")).alias("entity_id"), source.alias("source"), "country_key", "basic", F.array_join(F.slice(tk, 1, 5), " ").alias("business_name"), F.array_join(F.slice(tk, 6, 10), " ").alias("business_address"))
    return rows.withColumns({"country_raw": F.col("country_key"), "country": F.col("country_key")})


def text_digest() -> Column:
    """128 bits of a record's whole text; null where it has none. Records of one country are linked where it is equal."""
    return F.when(F.col("basic") != "", F.unhex(F.md5("basic")))


def silver_truth(records: DataFrame) -> DataFrame:
    """q, r of records of S1 and of the other sources with equal country and equal text_digest()."""
    rows = records.where("basic <> ''")
    side = lambda c, k: rows.where(c).select(F.col("entity_id").alias(k), "country_key", text_digest().alias("digest"))
    return side("source = 'S1'", "q").join(side("source <> 'S1'", "r"), ["country_key", "digest"]).select("q", "r")
