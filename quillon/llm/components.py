"""Connected components of a table of links, by alternating large and small stars until every component is one star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one link, that to its centre: then centres are the smallest nodes."""
    ends = edges.select(F.col("y").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("x").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
    out = both.where("y > x").join(low, "x").select(F.col("low").alias("x"), "y")
    return out.where("x <> y").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    low = edges.groupBy("y").agg(F.min("x").alias("low"))
    near = edges.join(low, "y")
    out = near.select(F.col("low").alias("x"), F.col("x").alias("y")).unionByName(low.select(F.col("low").alias("x"), "y"))
    return out.where("x <> y").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every node of the links (x, y); links from a node to itself name it only."""
    edges = links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()
    edges = common.table(edges, "edges")
    while not _stars(edges):
        edges, before = common.table(_small(_large(edges)), "edges"), edges
        common.drop_table(before)
    nodes = edges.select(F.col("y").alias("id"), F.col("x").alias("component"))
    return nodes.unionByName(edges.select(F.col("x").alias("id"), F.col("x").alias("component")).distinct())
