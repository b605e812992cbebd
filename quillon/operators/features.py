"""Features of candidate pairs.

Records' views are made once, before pairs meet them; then a pair's features are one wide projection, followed by one
window over each S1. Missing evidence is null, never NaN. ``s_`` columns are the S1 side, ``c_`` the candidate's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import similarity as sim
from quillon.functions import text as tx
from quillon.operators import tokens as tk
from quillon.operators.blocking import FINAL_CHANNELS

VIEWS = (
    "name_basic", "name_compact", "name_content", "name_content_compact", "name_fingerprint", "name_numbers", "name_script", "name_script_mixed", "name_missing",
    "address_basic", "address_compact", "address_fingerprint", "address_numbers", "address_missing", "country_key",
)
DERIVED = ("name_basic_x", "name_content_x", "address_basic_x", "legal", "initials")


def record_views(df: DataFrame, names: Column | None = None, addresses: Column | None = None, reference: bool = False) -> DataFrame:
    """Adds what only pairs need; on the reference side names are de-leeted and both fields translated (maps)."""
    same = lambda c: F.col(c)
    leet = tx.deleet(F.col("name_basic")) if reference else same("name_basic")
    content = tx.deleet(F.col("name_content")) if reference else same("name_content")
    df = df.withColumns({
        "name_basic_x": leet,
        "name_content_deleet": content if reference else tx.deleet(F.col("name_content")),
        "name_content_x": tx.translated(content, names) if reference and names is not None else content,
        "address_basic_x": tx.translated(F.col("address_basic"), addresses) if reference and addresses is not None else same("address_basic"),
    })
    return df.withColumns({"legal": tx.legal_tokens(F.col("name_basic_x"), F.col("country_key")), "initials": tx.initials(F.col("name_content_x"))})


def with_weights(df: DataFrame, reference: DataFrame, view: str, ref_view: str) -> DataFrame:
    """Adds <view>_w: token -> (idf in whole parts, rare) of each record's tokens, by the reference's frequencies."""
    n = reference.agg(F.count("*").alias("n"))
    table = tk.document_frequency(reference, ref_view).crossJoin(F.broadcast(n))
    table = table.select("token", tk.idf_feature(F.col("n"), F.col("df")).alias("w"), (F.col("df") <= tk.RARE_DF).alias("rare"))
    unseen = tk.idf_feature(F.col("n"), F.lit(0))
    rows = tk.exploded(df, view, "entity_id").join(table, "token", "left").crossJoin(F.broadcast(n))
    maps = rows.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", F.struct(F.coalesce("w", unseen).alias("w"), F.coalesce("rare", F.lit(True)).alias("rare")))))).alias(f"{view}_w"))
    return df.join(maps, "entity_id", "left")


def idf_overlap(a: Column, b: Column, prefix: str) -> dict[str, Column]:
    """Six figures of two weighted token maps; sums are of whole parts, so their order doesn't matter."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<w:bigint,rare:boolean>>"))
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    shared = F.map_filter(a, lambda k, _: F.map_contains_key(b, k))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, x: s + x["w"])
    both, one, two = total(shared), total(a), total(b)
    full = (F.size(a) > 0) & (F.size(b) > 0)
    return {
        f"{prefix}_shared_idf_sum": both / tk.PART, f"{prefix}_shared_idf_max": F.coalesce(F.array_max(F.transform(F.map_values(shared), lambda x: x["w"])), F.lit(0)) / tk.PART,
        f"{prefix}_idf_jaccard": F.when(full, both / (one + two - both)), f"{prefix}_s1_only_idf": (one - both) / tk.PART, f"{prefix}_cand_only_idf": (two - both) / tk.PART,
        f"{prefix}_shared_rare_count": F.size(F.filter(F.map_values(shared), lambda x: x["rare"])),
    }


def _flag(c: Column) -> Column:
    return c.cast("double")


def name_features(s, c) -> dict[str, Column]:
    out = {f"name_{k}_exact": sim.exact(s(v), c(v)) for k, v in (("basic", "name_basic"), ("compact", "name_compact"), ("content_compact", "name_content_compact"), ("fingerprint", "name_fingerprint"))}
    out |= {f"name_{k}": sim.similarity(k, s("name_basic"), c("name_basic")) for k in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "jaro_winkler")}
    out |= {f"{v}_ratio": sim.similarity("ratio", s(v), c(v)) for v in ("name_compact", "name_content", "name_content_compact")}
    out["name_content_token_set_ratio"] = sim.similarity("token_set_ratio", s("name_content"), c("name_content_x"))
    a, b = s("name_compact"), c("name_compact")
    out |= {"name_length_difference": sim.length_difference(a, b), "name_length_ratio": sim.length_ratio(a, b), "name_prefix_match": sim.prefix_match(a, b), "name_suffix_match": sim.suffix_match(a, b)}
    out |= sim.token_overlap(s("name_basic"), c("name_basic"), "name_tok") | sim.token_overlap(s("name_content"), c("name_content_x"), "name_content")
    out |= idf_overlap(s("name_content_w"), c("name_content_x_w"), "name_content")
    x, y = s("legal") != "", c("legal") != ""
    shared = F.arrays_overlap(tx.tokens(s("legal")), tx.tokens(c("legal")))
    out |= {"legal_both_present": _flag(x & y), "legal_conflict": F.when(x & y, _flag(~shared)), "legal_s1_present": _flag(x), "legal_cand_present": _flag(y)}
    out |= {"name_cand_is_s1_acronym": _flag((s("initials") != "") & (s("initials") == b)), "name_s1_is_cand_acronym": _flag((c("initials") != "") & (c("initials") == a))}
    return out | {"name_cand_non_latin": _flag(c("name_script") != "Latin"), "name_cand_mixed_script": _flag(c("name_script_mixed"))}


def address_features(s, c) -> dict[str, Column]:
    out = {f"address_{k}_exact": sim.exact(s(f"address_{k}"), c(f"address_{k}")) for k in ("basic", "compact", "fingerprint")}
    a, b = s("address_basic"), c("address_basic")
    out |= {f"address_{k}": sim.similarity(k, a, b) for k in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")}
    out["address_translated_token_set_ratio"] = sim.similarity("token_set_ratio", a, c("address_basic_x"))
    out |= {"address_length_difference": sim.length_difference(a, b), "address_length_ratio": sim.length_ratio(a, b)}
    return out | sim.token_overlap(a, c("address_basic_x"), "address") | idf_overlap(s("address_basic_w"), c("address_basic_x_w"), "address")


def numeric_features(s, c) -> dict[str, Column]:
    a, b = s("address_numbers"), c("address_numbers")
    x, y = tx.tokens(a), tx.tokens(b)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    long_a, long_b = tx.tokens(tx.long_numbers(a)), tx.tokens(tx.long_numbers(b))
    n, m = tx.tokens(s("name_numbers")), tx.tokens(c("name_numbers"))
    return sim.token_overlap(a, b, "number") | {
        "number_conflict": F.when(both, _flag(~F.arrays_overlap(x, y))), "number_set_exact": F.when(both, _flag(F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y)))),
        "number_first_equal": F.when(both, _flag(tx.first_token(a) == tx.first_token(b))), "long_number_overlap": F.when((F.size(long_a) > 0) & (F.size(long_b) > 0), _flag(F.arrays_overlap(long_a, long_b))),
        "name_number_conflict": F.when((F.size(n) > 0) & (F.size(m) > 0), _flag(~F.arrays_overlap(n, m))), "name_number_s1_only": _flag((F.size(n) > 0) & (F.size(m) == 0)),
    }


def missing_features(s, c) -> dict[str, Column]:
    return {
        "country_equal": _flag(s("country_key") == c("country_key")), "country_missing_s1": _flag(s("country_key") == ""), "country_missing_cand": _flag(c("country_key") == ""),
        "candidate_source_is_s2": _flag(F.col("r").startswith("S2-")), "name_missing_s1": _flag(s("name_missing")), "name_missing_cand": _flag(c("name_missing")),
        "address_missing_s1": _flag(s("address_missing")), "address_missing_cand": _flag(c("address_missing")), "both_address_missing": _flag(s("address_missing") & c("address_missing")),
    }


def blocking_features(names=tuple(c.name for c in FINAL_CHANNELS), ranked: str = "hybrid_translated") -> dict[str, Column]:
    out = {f"blocked_{c}": _flag(F.col("mask").bitwiseAND(1 << i) != 0) for i, c in enumerate(names)}
    rank = F.col(f"{ranked}_rank")
    return out | {"blocking_channel_count": F.bit_count("mask").cast("double"), "candidates_for_source1": F.col("candidates_for_source1").cast("double"), f"{ranked}_rank": F.when(rank >= 0, rank.cast("double"))}


def cross_field() -> dict[str, Column]:
    """From name_token_set_ratio and address_token_set_ratio, and the two idf_jaccard columns."""
    n, a = F.col("name_token_set_ratio"), F.col("address_token_set_ratio")
    present = F.array_compact(F.array(n, a))
    return {
        "name_address_min": F.least(n, a), "name_address_product": n * a, "name_address_mean": F.try_divide(F.aggregate(present, F.lit(0.0), lambda s, x: s + x), F.size(present)),
        "combined_idf_evidence": F.coalesce("name_content_idf_jaccard", F.lit(0.0)) + F.coalesce("address_idf_jaccard", F.lit(0.0)),
    }


RELATIVE = ("name_token_set_ratio", "address_token_set_ratio", "combined_idf_evidence", "name_content_idf_jaccard")


def relative(df: DataFrame, scores=RELATIVE, exact: str = "name_content_compact_exact", group: str = "q", tie: str = "r") -> DataFrame:
    """Adds, for each score, its rank in the S1 (ties share the least), margin to the best and, for the best, lead over
    the second; and how many candidates have the exact content name. Missing scores rank as -1."""
    out = df
    whole = Window.partitionBy(group)
    for v in scores:
        x = F.coalesce(F.col(v), F.lit(-1.0))
        order = Window.partitionBy(group).orderBy(x.desc(), F.col(tie))
        best = F.max(x).over(whole)
        second = F.coalesce(F.nth_value(x, 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(-1.0))
        out = out.withColumns({
            f"{v}_rank_in_s1": F.rank().over(Window.partitionBy(group).orderBy(x.desc())).cast("double"), f"{v}_margin_to_best": best - x, f"{v}_lead_over_second": F.when(x == best, x - second),
        })
    return out.withColumn("s1_candidates_with_exact_content_name", F.sum(F.coalesce(F.col(exact), F.lit(0.0))).over(whole))


def name_only_features(s, c) -> dict[str, Column]:
    a, b, leet = s("name_compact"), c("name_compact"), tx.compact(c("name_basic_x"))
    jaccard = sim.char_jaccard(a, b)
    return {
        "name_char3_jaccard": jaccard, "name_common_prefix_share": sim.common_prefix_share(a, b), "name_deleet_ratio": sim.similarity("ratio", a, leet), "name_deleet_jaro_winkler": sim.similarity("jaro_winkler", a, leet),
        "name_wratio": sim.similarity("weighted_ratio", s("name_basic"), c("name_basic")), "name_evidence_no_address": F.when(c("address_missing"), sim.similarity("token_set_ratio", s("name_basic"), c("name_basic"))),
        "char3_no_address": F.when(c("address_missing"), jaccard),
    }


def street_features(s, c) -> dict[str, Column]:
    """Needs street_views() on both sides."""
    tsr = sim.similarity("token_set_ratio", s("street_core"), c("street_core"))
    same = (s("street_number") != "") & (s("street_number") == c("street_number"))
    forms = (s("legal_dotted") != "") & (c("legal_dotted") != "")
    given = lambda x: F.when(tsr.isNotNull(), _flag(x))
    return {
        "street_core_ratio": sim.similarity("ratio", s("street_core"), c("street_core")), "street_core_token_set_ratio": tsr, "street_core_conflict": given(tsr < 0.6), "street_same_number_diff_street": given(same & (tsr < 0.6)),
        "street_house_match": given(same & (tsr >= 0.85)), "legal_conflict_dotted": F.when(forms, _flag(~F.arrays_overlap(tx.tokens(s("legal_dotted")), tx.tokens(c("legal_dotted"))))),
    }


def transliteration_features(s, c) -> dict[str, Column]:
    a, b = tx.transliterated(s("name_nfkc")), tx.transliterated(c("name_nfkc"))
    x, y = tx.skeleton(tx.compact(a)), tx.skeleton(tx.compact(b))
    return {
        "t_name_ratio": sim.similarity("ratio", a, b), "t_name_token_set_ratio": sim.similarity("token_set_ratio", a, b), "t_skeleton_ratio": sim.similarity("ratio", x, y),
        "t_skeleton_partial_ratio": sim.similarity("partial_ratio", x, y), "t_cand_non_latin": _flag(c("name_nfkc").rlike(r"[^\x{0}-\x{24F}]")),
    }


def paired(pairs: DataFrame, s1: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairs with both records' columns, s_ and c_; a pair of an id without a record is an error, not a lost row.

    The reference comes first: pairs of blocking.union() by "r" lie so already, and what reads the result goes on by q.
    """
    side = lambda d, p, k: d.select(*(F.col(x).alias(k if x == "entity_id" else f"{p}_{x}") for x in d.columns), F.lit(True).alias(f"__{p}"))
    rows = pairs.join(side(reference, "c", "r"), "r", "left").join(side(s1, "s", "q"), "q", "left")
    known = F.coalesce("__s", F.lit(False)) & F.coalesce("__c", F.lit(False))
    return rows.where(F.assert_true(known, F.concat(F.lit("no record of the pair "), F.col("q"), F.lit(" "), F.col("r"))).isNull()).drop("__s", "__c")


def build(pairs: DataFrame, s1: DataFrame, reference: DataFrame, truth: DataFrame | None = None, version: int = 1) -> DataFrame:
    """q, r, all features of the version (1: 110, 2: 117, 3: 123) and, with truth (q, r), label.

    pairs: as blocking.generate() gives them; s1, reference: record_views() with_weights() of both fields.
    """
    s, c = (lambda v: F.col(f"s_{v}")), (lambda v: F.col(f"c_{v}"))
    blocks = [name_features(s, c), address_features(s, c), numeric_features(s, c), missing_features(s, c), blocking_features()]
    blocks += [name_only_features(s, c)] * (version >= 2) + [street_features(s, c)] * (version >= 3)
    cols = reduce(lambda x, y: x | y, blocks)
    rows = paired(pairs, s1, reference).select("q", "r", *(v.alias(k) for k, v in cols.items()))
    rows = rows.withColumns({k: v for k, v in cross_field().items()})
    rows = relative(rows)
    if truth is None:
        return rows
    return rows.join(truth.select("q", "r").distinct().withColumn("label", F.lit(1)), ["q", "r"], "left").fillna(0, ["label"])


def prepared(s1: DataFrame, reference: DataFrame, names: Column | None = None, addresses: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of normalised records, ready for build()."""
    left, right = record_views(s1), record_views(reference, names, addresses, reference=True)
    right_plain = right
    for view, ref_view in (("name_content", "name_content_x"), ("address_basic", "address_basic_x")):
        left = with_weights(left, right_plain, view, ref_view)
        right = with_weights(right, right_plain, ref_view, ref_view)
    return left, right
