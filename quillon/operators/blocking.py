"""Candidate generation: guarded equi-joins, inverted-index top-k joins, their union with provenance, and its evaluation.

Records have entity_id and country_key and the views that a channel reads; pairs are (q, r). Country is in every join
key, so partitions prune. A reference block over its limit is skipped for its key, never cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.operators import retrieval
from quillon.operators import tokens as tk

MAX_BLOCK, MAX_NUMBER_BLOCK, MAX_DF, TOP_K = 1000, 500, 50_000, 100


def _guarded(queries: DataFrame, reference: DataFrame, keys: list[str], max_block: int) -> DataFrame:
    """q, r of rows with equal keys; the guard counts before the join, so an oversize block is never expanded."""
    small = reference.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") <= max_block).drop("n")
    kept = reference.join(small, keys)
    return queries.withColumnRenamed("entity_id", "q").join(kept.withColumnRenamed("entity_id", "r"), keys).select("q", "r")


def exact_block(queries: DataFrame, reference: DataFrame, view: str, max_block: int = MAX_BLOCK) -> DataFrame:
    """Pairs whose view is equal and not ''."""
    side = lambda d: d.select("entity_id", "country_key", F.col(view).alias("key")).where("key <> ''")
    return _guarded(side(queries), side(reference), ["country_key", "key"], max_block)


def keyed(queries: DataFrame, reference: DataFrame, channels: dict[str, Channel]) -> tuple[DataFrame, DataFrame]:
    """Both sides with numbers, by their names, that are equal where a channel's exact_block() pairs them: 64 bits of hash of the view, null of '' and of an oversize block."""
    out = reference
    for name, c in channels.items():
        own = F.when(F.col(c.views[0]) != "", F.xxhash64(c.views[0])).alias(name)
        large = reference.select("country_key", own).where(F.col(name).isNotNull()).groupBy("country_key", name).agg(F.count("*").alias("n")).where(F.col("n") > c.options.get("max_block", MAX_BLOCK))
        out = out.withColumn(name, own).join(F.broadcast(large), ["country_key", name], "left")  # fewer than one of max_block rows
        out = out.withColumn(name, F.when(F.col("n").isNull(), F.col(name))).drop("n")
        queries = queries.withColumn(name, own)
    return queries, out


def number_block(queries: DataFrame, reference: DataFrame, view: str = "address_numbers", max_block: int = MAX_NUMBER_BLOCK, min_digits: int = 1) -> DataFrame:
    """Pairs that share a number; the guard holds for each number alone."""
    side = lambda d: tk.exploded(d, view, "entity_id", "country_key").where(F.length("token") >= min_digits)
    return _guarded(side(queries), side(reference), ["country_key", "token"], max_block).distinct()


def marked(views: Sequence[str | Column]) -> Column:
    """Distinct tokens of all views, marked with the place of their view so that fields never cross."""
    cols = [F.col(v) if isinstance(v, str) else v for v in views]
    mark = lambda i: lambda t: F.concat(F.lit(f"{i}:"), t)
    return F.array_distinct(F.concat(*(F.transform(tx.tokens(c), mark(i)) for i, c in enumerate(cols))))


def bag(df: DataFrame, views: Sequence[str | Column]) -> DataFrame:
    """entity_id, country_key, token: each row's marked() tokens."""
    return df.select("entity_id", "country_key", F.explode(marked(views)).alias("token"))


def vectors(rows: DataFrame, value: Column) -> DataFrame:
    """id, country_key, tokens (hashed), values, of rows entity_id, country_key, token, as retrieval.top_k() takes them."""
    held = rows.groupBy("entity_id", "country_key").agg(F.collect_set(F.struct(F.xxhash64("token").alias("t"), value.alias("x"))).alias("v"))
    return held.select(F.col("entity_id").alias("id"), "country_key", F.col("v.t").alias("tokens"), F.col("v.x").alias("values"))


def idf_top_k(queries: DataFrame, reference: DataFrame, views: Sequence[str | Column], max_df: int = MAX_DF, top_k: int = TOP_K, ref_views: Sequence[str | Column] | None = None, carried: retrieval.Carried | None = None, keyed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """q, r, score (in whole parts), rank (from 0), what carried gives: the rows with the largest sum of IDFs of shared tokens.

    keyed: both sides with carried's keys.

    Frequencies are counted in the reference of each country; tokens beyond max_df are left out, ties go to the smaller id.
    Only the queries' tokens meet their IDF; the search reads inverted lists and makes no row for a shared token.
    """
    n = reference.groupBy("country_key").agg(F.count("*").alias("n"))
    weights = bag(reference, ref_views or views).groupBy("country_key", "token").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    weights = weights.join(F.broadcast(n), "country_key").select("country_key", "token", tk.idf_blocking(F.col("n"), F.col("df")).alias("w")).where("w > 0")
    left = vectors(bag(queries, views).join(weights, ["country_key", "token"]), F.col("w"))
    more = (*carried.columns, *carried.keys) if carried else ()
    if carried:  # rows without tokens may have equal keys
        none = F.array().cast("array<bigint>")
        left = (keyed[0] if keyed else queries).select(F.col("entity_id").alias("id"), "country_key", *more).join(left.drop("country_key"), "id", "left")
        left = left.withColumns({c: F.coalesce(c, none) for c in ("tokens", "values")})
    right = (keyed[1] if keyed else reference).select(F.col("entity_id").alias("id"), "country_key", F.transform(marked(ref_views or views), lambda t: F.xxhash64(t)).alias("tokens"), *more)
    right = right if carried and carried.keys else right.where(F.size("tokens") > 0)
    return retrieval.top_k(left, right, reference, queries, top_k, carried)


def char_ngrams(df: DataFrame, view: str, sizes: tuple[int, int] = (3, 4)) -> DataFrame:
    """entity_id, country_key, token, tf: character n-grams inside words, each with a space at both ends."""
    word = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    gram = lambda n: lambda i: word.substr(i, F.lit(n))
    grams = [F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), gram(n))).otherwise(F.array().cast("array<string>")) for n in range(sizes[0], sizes[1] + 1)]
    rows = df.select("entity_id", "country_key", F.explode(tx.tokens(F.col(view))).alias("w"))
    rows = rows.select("entity_id", "country_key", F.explode(F.concat(*grams)).alias("token"))
    return rows.groupBy("entity_id", "country_key", "token").agg(F.count("*").alias("tf"))


def char_top_k(queries: DataFrame, reference: DataFrame, view: str, sizes: tuple[int, int] = (3, 4), min_df: int = 2, max_df: int = 20_000, top_k: int = 50, only_empty_address: bool = False, deleet_reference: bool = False, carried: retrieval.Carried | None = None) -> DataFrame:
    """q, r, score, rank, what carried gives: cosine of TF-IDF vectors of character n-grams (sublinear tf, smoothed idf), in whole parts.

    The reference may be held to records without an address, and its texts de-leeted.
    """
    if only_empty_address:
        reference = reference.where("address_basic = ''")
    if deleet_reference:
        reference = reference.withColumn(view, tx.deleet(F.col(view)))
    right = char_ngrams(reference, view, sizes)
    n = reference.groupBy("country_key").agg(F.count("*").alias("n"))
    idf = right.groupBy("country_key", "token").agg(F.count("*").alias("df")).where(F.col("df").between(min_df, max_df)).join(F.broadcast(n), "country_key")
    idf = idf.select("country_key", "token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def unit(rows: DataFrame) -> DataFrame:
        rows = vectors(rows.join(idf, ["country_key", "token"]), F.round((1 + F.log("tf")) * F.col("idf") * 1e6).cast("long"))
        rows = rows.withColumn("norm", F.sqrt(F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x * x)))
        both = F.arrays_zip("tokens", F.transform("values", lambda x: F.round(x / F.col("norm") * 1e6).cast("long")).alias("values"))
        some = F.filter(both, lambda v: v["values"] > 0)
        return rows.select("id", "country_key", some["tokens"].alias("tokens"), some["values"].alias("values"))

    with_more = lambda rows, d: rows.join(d.select(F.col("entity_id").alias("id"), *carried.columns), "id") if carried else rows
    return retrieval.top_k(with_more(unit(char_ngrams(queries, view, sizes)), queries), with_more(unit(right), reference), reference, queries, top_k, carried)


@dataclass(frozen=True)
class Channel:
    """One way to find candidates: kind is exact, number, tokens or chars."""

    name: str
    kind: str
    views: tuple[str, ...]
    options: dict = field(default_factory=dict)
    ref_views: tuple[str, ...] | None = None

    def run(self, queries: DataFrame, reference: DataFrame, carried: retrieval.Carried | None = None, keyed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """q, r, rank (-1 where the channel has none), and what carried gives where the channel searches."""
        more = carried.told if carried else ()
        if self.kind == "exact":
            return exact_block(queries, reference, self.views[0], **self.options).withColumn("rank", F.lit(-1))
        if self.kind == "number":
            return number_block(queries, reference, self.views[0], **self.options).withColumn("rank", F.lit(-1))
        if self.kind == "chars":
            return char_top_k(queries, reference, self.views[0], carried=carried, **self.options).select("q", "r", "rank", *more)
        return idf_top_k(queries, reference, self.views, ref_views=self.ref_views, carried=carried, keyed=keyed, **self.options).select("q", "r", "rank", *more)


#: The last needs records prepared as pairs' features need them (features.prepared): names de-leeted, the reference translated.
FINAL_CHANNELS = (
    Channel("content_name", "exact", ("name_content",)),
    Channel("fingerprint_name", "exact", ("name_fingerprint",)),
    Channel("fingerprint_address", "exact", ("address_fingerprint",)),
    Channel("hybrid_translated", "tokens", ("name_content_deleet", "address_basic"), ref_views=("name_content_x", "address_basic_x")),
)


def union(found: dict[str, DataFrame], by: str = "q") -> DataFrame:
    """q, r, mask (bit i: channel i), <channel>_rank (-1: not ranked): each pair once, from all channels; they lie by q, or by r."""
    names = list(found)
    parts = [df.select("q", "r", F.lit(1 << i).alias("bit"), F.lit(i).alias("channel"), "rank") for i, df in enumerate(found.values())]
    rows = reduce(DataFrame.unionByName, parts)
    ranks = [F.coalesce(F.max(F.when(F.col("channel") == i, F.col("rank"))), F.lit(-1)).alias(f"{c}_rank") for i, c in enumerate(names)]
    return rows.repartition(by).groupBy("q", "r").agg(F.bit_or("bit").alias("mask"), *ranks)


def generate(queries: DataFrame, reference: DataFrame, channels: Sequence[Channel] = FINAL_CHANNELS, by: str = "q") -> DataFrame:
    """Pairs of all channels with provenance: union(), blocking_channels, num_blocking_channels, candidates_for_source1."""
    pairs = union({c.name: c.run(queries, reference) for c in channels}, by)
    return labelled(pairs, [c.name for c in channels])


def labelled(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    label = F.array_join(F.filter(F.array(*(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(names))), lambda x: x.isNotNull()), "|")
    return pairs.withColumns({"blocking_channels": label, "num_blocking_channels": F.bit_count("mask"), "candidates_for_source1": F.count("*").over(Window.partitionBy("q"))})


def subset(pairs: DataFrame, mask: int) -> DataFrame:
    """Pairs that one of the mask's channels found."""
    return pairs.where(F.col("mask").bitwiseAND(mask) != 0)


def ceiling(recall: Column) -> Column:
    """Best F0.5 of an entity whose candidates hold this part of its truth."""
    return F.when(recall > 0, 1.25 * recall / (0.25 + recall)).otherwise(0.0)


def evaluate(pairs: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each country and ALL: recall of pairs, queries with all and any found, ceiling, set sizes.

    truth: q, r; queries: entity_id, country_key (all of them, with or without truth).
    """
    found = truth.join(pairs.select("q", "r").distinct().withColumn("hit", F.lit(1)), ["q", "r"], "left")
    t = found.groupBy("q").agg(F.count("*").alias("true"), F.count("hit").alias("found"))
    size = pairs.groupBy("q").agg(F.count("*").alias("size"))
    rows = queries.select(F.col("entity_id").alias("q"), "country_key").join(t, "q", "left").join(size, "q", "left").fillna(0, ["true", "found", "size"])
    per = rows.withColumn("ceiling", F.when(F.col("true") > 0, ceiling(F.col("found") / F.greatest(F.col("true"), F.lit(1)))).otherwise(1.0))
    share = lambda c: F.round(F.try_divide(F.count_if((F.col("true") > 0) & c), F.count_if(F.col("true") > 0)), 6)
    return per.rollup("country_key").agg(
        F.count("*").alias("queries"), F.sum("true").alias("true_pairs"), F.sum("found").alias("found_pairs"), F.round(F.try_divide(F.sum("found"), F.sum("true")), 6).alias("pair_recall"),
        share(F.col("found") == F.col("true")).alias("all_found"), share(F.col("found") > 0).alias("any_found"), F.round(F.avg("ceiling"), 6).alias("f05_ceiling"),
        F.round(F.avg("size"), 6).alias("mean_size"), F.max("size").alias("max_size"), F.percentile("size", F.lit(0.5)).alias("median_size"),
    ).withColumn("country_key", F.coalesce("country_key", F.lit("ALL")))


def recall_at_k(ranked: DataFrame, truth: DataFrame, ks: Sequence[int] = (5, 10, 25, 50, 100, 200)) -> DataFrame:
    """k, pairs, found, recall for each cut of a ranked channel."""
    hit = ranked.select("q", "r", "rank").join(truth.withColumn("hit", F.lit(1)), ["q", "r"], "left")
    by_rank = hit.groupBy("rank").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    total = truth.agg(F.count("*").alias("true"))
    grid = by_rank.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank", "n", "h").where("rank < k")
    out = grid.groupBy("k").agg(F.sum("n").alias("pairs"), F.sum("h").alias("found"))
    return out.crossJoin(F.broadcast(total)).select("k", "pairs", "found", F.round(F.try_divide("found", "true"), 6).alias("recall"))


def channel_subsets(pairs: DataFrame, truth: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairs and recall of the first channels together, and of all but one: (kind, channel, pairs, found, recall)."""
    every = (1 << len(names)) - 1
    masks = [("cumulative", c, (2 << i) - 1) for i, c in enumerate(names)] + [("without", c, every & ~(1 << i)) for i, c in enumerate(names)]
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("channel"), F.lit(m).alias("m")) for k, c, m in masks)))
    rows = pairs.join(truth.withColumn("hit", F.lit(1)), ["q", "r"], "left").groupBy("mask").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    out = rows.select("mask", "n", "h", grid.alias("g")).where(F.col("mask").bitwiseAND(F.col("g.m")) != 0).groupBy("g.kind", "g.channel").agg(F.sum("n").alias("pairs"), F.sum("h").alias("found"))
    return out.crossJoin(F.broadcast(truth.agg(F.count("*").alias("true")))).select("kind", "channel", "pairs", "found", F.round(F.try_divide("found", "true"), 6).alias("recall"))


def union_at_k(pairs: DataFrame, truth: DataFrame, ranked: Sequence[str], ks: Sequence[int] = (5, 10, 25, 50, 100)) -> DataFrame:
    """Pairs and recall of the union where ranked channels are cut at k; others count whole."""
    rank = F.array(*(F.when(F.col(f"{c}_rank") >= 0, F.col(f"{c}_rank")) for c in ranked))
    bits = F.col("num_blocking_channels") - F.size(F.filter(rank, lambda r: r.isNotNull()))
    rows = pairs.select("q", "r", F.when(bits > 0, F.lit(-1)).otherwise(F.array_min(rank)).alias("rank"))
    return recall_at_k(rows, truth, ks)


SIZE_BINS = (0, 1, 2, 5, 10, 20, 50, 75, 100, 125, 150, 200, 300)


def size_histogram(pairs: DataFrame, queries: DataFrame, bins: Sequence[int] = SIZE_BINS) -> DataFrame:
    """bin (its least size), queries: how many queries have so many candidates; empty bins have 0."""
    size = queries.select(F.col("entity_id").alias("q")).join(pairs.groupBy("q").agg(F.count("*").alias("n")), "q", "left").fillna(0, ["n"])
    of = reduce(lambda c, b: F.when(F.col("n") >= b, F.lit(b)).otherwise(c), sorted(bins), F.lit(None).cast("int"))
    counted = size.groupBy(of.alias("bin")).agg(F.count("*").alias("queries"))
    edges = pairs.sparkSession.createDataFrame([(b,) for b in bins], "bin int")
    return edges.join(counted, "bin", "left").select("bin", F.coalesce("queries", F.lit(0)).cast("long").alias("queries"))


def largest_sets(pairs: DataFrame, n: int = 50) -> DataFrame:
    """The queries with most candidates."""
    return pairs.groupBy("q").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "q").limit(n)


def miss_reasons(truth: DataFrame, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """q, r of true pairs that no channel found, and which evidence they share."""
    views = ("name_basic", "address_basic", "address_numbers")
    side = lambda d, k: d.select(F.col("entity_id").alias(k), *(F.array_distinct(tx.tokens(F.col(v))).alias(f"{k}_{v}") for v in views))
    missed = truth.join(pairs, ["q", "r"], "left_anti").join(side(left, "q"), "q").join(side(right, "r"), "r")
    return missed.select("q", "r", *(F.coalesce(F.arrays_overlap(f"q_{v}", f"r_{v}"), F.lit(False)).alias(f"shares_{v}") for v in views), (F.size("r_address_basic") == 0).alias("r_address_missing"))


def integrity(pairs: DataFrame) -> DataFrame:
    """Counts of what must not be: wrong prefixes, repeated pairs, pairs without a channel."""
    return pairs.agg(
        F.count_if(~F.col("q").startswith("S1-") | ~F.col("r").rlike("^S[23]-")).alias("bad_prefix"),
        (F.count("*") - F.count_distinct("q", "r")).alias("repeated"), F.count_if(F.col("mask") == 0).alias("without_channel"),
    )
