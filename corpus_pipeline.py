"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``documents``. SQL can't express the stages' models and hashes, so there is no ORACLE_SQL; the
tests hold every stage against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common, langid, neardup, packing, substring, toxicity

STAGES = [
    ("language_id", langid.keep_identified),
    ("toxicity", toxicity.drop_toxic),
    ("near_dedup", neardup.keep_one_each),
    ("substring_dedup", substring.cut_repeats),
    ("packing", packing.packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
