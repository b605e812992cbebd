"""The second stage: each pair seen with the other pairs of its S1, and with the competition for its candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import similarity as sim

ANCHOR_P, MOST_ANCHORS = 0.9, 5


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def probability_structure(pairs: DataFrame) -> DataFrame:
    """Adds what a pair's probability is among those of its S1 and source. pairs: q, r, p."""
    s1, own = Window.partitionBy("q"), Window.partitionBy("q", F.substring("r", 1, 2))
    order = s1.orderBy(F.desc("p"), "r")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda t, w: F.sum((F.col("p") >= t).cast("int")).over(w)
    rows = pairs.withColumns({
        "logit_p": logit(F.col("p")), "rank": F.row_number().over(order) - 1, "best": F.first("p").over(whole), "second": F.coalesce(F.nth_value("p", 2).over(whole), F.lit(0.0)),
        "n_ge_05": over(0.5, s1), "n_ge_08": over(0.8, s1), "n_ge_095": over(0.95, s1), "n_kept": F.count("*").over(s1), "is_s2": F.col("r").startswith("S2-").cast("int"),
        "source_rank": F.row_number().over(own.orderBy(F.desc("p"), "r")) - 1, "source_n_ge_08": over(0.8, own),
    })
    lead = F.col("p") - F.when(F.col("rank") == 0, F.col("second")).otherwise(F.col("best"))
    return rows.withColumns({"p_over_best": F.try_divide("p", "best"), "gap_best": F.col("best") - F.col("p"), "lead_over_second": lead})


def anchors(pairs: DataFrame) -> DataFrame:
    """q, a, p_a: the first candidates of an S1 with a probability of at least ANCHOR_P."""
    order = Window.partitionBy("q").orderBy(F.desc("p"), "r")
    return pairs.where(F.col("p") >= ANCHOR_P).withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_ANCHORS).select("q", F.col("r").alias("a"), F.col("p").alias("p_a"))


def anchor_agreement(pairs: DataFrame, reference: DataFrame, plain: bool = False) -> DataFrame:
    """q, r and how a candidate agrees with the anchors of its S1, itself left out. Each S1 has at most five anchors, so
    the join grows with the pairs. plain: only what needs no Python.

    reference: entity_id, name_basic, name_content_compact, address_basic, street_core, street_number.
    """
    met = pairs.select("q", "r").join(anchors(pairs), "q").where("r <> a")
    views = ("name_basic", "name_content_compact", "address_basic", "street_core", "street_number")
    side = lambda k, p: reference.select(F.col("entity_id").alias(k), *(F.col(v).alias(f"{p}_{v}") for v in views))
    met = met.join(side("r", "c"), "r").join(side("a", "a"), "a")
    exact = sim.exact(F.col("c_name_content_compact"), F.col("a_name_content_compact"))
    number = F.when((F.col("c_street_number") != "") & (F.col("a_street_number") != ""), (F.col("c_street_number") == F.col("a_street_number")).cast("double"))
    cols = {"name_exact": exact, "number_equal": number}
    if not plain:
        cols |= {"name_tsr": sim.similarity("token_set_ratio", F.col("c_name_basic"), F.col("a_name_basic")), "addr_tsr": sim.similarity("token_set_ratio", F.col("c_address_basic"), F.col("a_address_basic")), "street": sim.similarity("token_set_ratio", F.col("c_street_core"), F.col("a_street_core"))}
    rows = met.select("q", "r", "p_a", *(c.alias(k) for k, c in cols.items()))
    out = [F.count("*").alias("n_anchors"), F.max("p_a").alias("anc_p_max"), F.max("name_exact").alias("anc_name_exact_any"), F.max("number_equal").alias("anc_number_equal_any"), F.avg("number_equal").alias("anc_number_equal_share")]
    if not plain:
        out += [f(c).alias(f"anc_{c}_{n}") for c in ("name_tsr", "addr_tsr") for f, n in ((F.max, "max"), (F.avg, "mean"))] + [F.max("street").alias("anc_street_max"), F.min("street").alias("anc_street_min")]
    seen = rows.groupBy("q", "r").agg(*out)
    return pairs.select("q", "r").join(seen, ["q", "r"], "left").fillna(0, ["n_anchors"])


def universe_counts(s1: DataFrame, reference: DataFrame) -> dict[str, DataFrame]:
    """How many S1 and reference records have a name, and how many S1 a name and house number, in each country."""
    name = ["country_key", "name_content_compact"]
    full = lambda d: d.where("name_content_compact <> ''")
    return {
        "s1_name": full(s1).groupBy(*name).agg(F.count("*").alias("u_s1_name_count")), "s1_name_number": full(s1).groupBy(*name, "street_number").agg(F.count("*").alias("u_s1_name_number_count")),
        "ref_name": full(reference).groupBy(*name).agg(F.count("*").alias("u_ref_name_count")),
    }


def universe_features(pairs: DataFrame, s1: DataFrame, reference: DataFrame, counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """q, r and how common both names are among all records; null where the name is ''."""
    counts = counts or universe_counts(s1, reference)
    views = ("country_key", "name_content_compact", "street_number")
    rows = pairs.select("q", "r").join(s1.select(F.col("entity_id").alias("q"), *views), "q")
    rows = rows.join(counts["s1_name"], ["country_key", "name_content_compact"], "left").join(counts["s1_name_number"], list(views), "left").join(counts["ref_name"], ["country_key", "name_content_compact"], "left")
    rows = rows.select("q", "r", F.col("name_content_compact").alias("s_name"), "u_s1_name_count", "u_s1_name_number_count", "u_ref_name_count")
    names = reference.select(F.col("entity_id").alias("r"), "country_key", "name_content_compact").join(counts["s1_name"].withColumnRenamed("u_s1_name_count", "u_cand_name_s1_count"), ["country_key", "name_content_compact"], "left")
    rows = rows.join(names.select("r", F.col("name_content_compact").alias("c_name"), "u_cand_name_s1_count"), "r")
    number = lambda c, n: F.when(F.col(n) != "", F.coalesce(F.col(c), F.lit(0)))
    rows = rows.select("q", "r", *(number(c, "s_name").alias(c) for c in ("u_s1_name_count", "u_s1_name_number_count", "u_ref_name_count")), number("u_cand_name_s1_count", "c_name").alias("u_cand_name_s1_count"))
    return rows.withColumn("u_refs_per_s1_name", F.try_divide("u_ref_name_count", "u_s1_name_count"))


def direct_evidence(pairs: DataFrame, s1: DataFrame, reference: DataFrame) -> DataFrame:
    """q, r and the similarity of the two records themselves."""
    from quillon.operators.features import paired, street_features

    s, c = (lambda v: F.col(f"s_{v}")), (lambda v: F.col(f"c_{v}"))
    rows = paired(pairs.select("q", "r"), s1, reference)
    cols = {"d_name_tsr": sim.similarity("token_set_ratio", s("name_basic"), c("name_basic")), "d_addr_tsr": sim.similarity("token_set_ratio", s("address_basic"), c("address_basic")), "cand_address_missing": c("address_missing").cast("double")}
    return rows.select("q", "r", *(v.alias(k) for k, v in (cols | street_features(s, c)).items()))


def collective_features(pairs: DataFrame, s1: DataFrame, reference: DataFrame, universe: bool = True) -> DataFrame:
    """All second-stage features of pairs (q, r, p, ...); records with street_views(). A pair that a block lacks is an error."""
    blocks = [anchor_agreement(pairs, reference), direct_evidence(pairs, s1, reference), *([universe_features(pairs, s1, reference)] if universe else [])]
    out = probability_structure(pairs)
    for i, block in enumerate(blocks):
        out = out.join(block.withColumn(f"__{i}", F.lit(True)), ["q", "r"], "left")
        out = out.where(F.assert_true(F.coalesce(f"__{i}", F.lit(False)), F.concat(F.lit("no features of the pair "), F.col("q"), F.lit(" "), F.col("r"))).isNull()).drop(f"__{i}")
    return out
