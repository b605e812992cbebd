"""The whole linkage as one plan: normalise, find candidates, build features, score, decide, look again, decide."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import blocking, collective, decision, features
from quillon.operators import tokens as tk


def learn_dictionaries(s1: DataFrame, reference: DataFrame, truth: DataFrame) -> tuple[Column | None, Column | None]:
    """Map literals of the translations of names and addresses that true pairs teach."""
    out = []
    for view, target in (("name_content", tx.deleet(F.col("name_content"))), ("address_basic", F.col("address_basic"))):
        pairs = truth.join(s1.select(F.col("entity_id").alias("q"), F.col(view).alias("s1_text")), "q").join(reference.select(F.col("entity_id").alias("r"), target.alias("target_text")), "r")
        words = tk.dictionary(tk.learn_translation(pairs, s1, reference, view))
        out.append(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)) if words else None)
    return tuple(out)


def candidates(s1: DataFrame, reference: DataFrame, channels: Sequence[blocking.Channel] = blocking.FINAL_CHANNELS) -> DataFrame:
    """Pairs of all channels; records as features.prepared gives them."""
    return blocking.generate(s1, reference, channels)


def score_pairs(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """q, r, p and country_key, ready for decisions."""
    return scorer(pairs)


def first_stage(s1: DataFrame, reference: DataFrame, scorer: Callable[[DataFrame], DataFrame], params: decision.Params = decision.STAGE_ONE, channels: Sequence[blocking.Channel] = blocking.FINAL_CHANNELS, truth: DataFrame | None = None, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Scored pairs and matches of normalised records."""
    names, addresses = learn_dictionaries(s1, reference, truth) if truth is not None else (None, None)
    left, right = features.prepared(s1, reference, names, addresses)
    if version >= 3:
        left, right = tx.street_views(left), tx.street_views(right)
    rows = features.build(candidates(left, right, channels), left, right, version=version)
    scored = score_pairs(rows, scorer)
    return scored, decision.decide(scored.select("q", "r", "p"), params)


def second_stage(scored: DataFrame, s1: DataFrame, reference: DataFrame, rescorer: Callable[[DataFrame], DataFrame], params: decision.Params = decision.STAGE_TWO) -> DataFrame:
    """Matches after each pair was seen with the others; records with street views."""
    kept = scored.where(F.col("p") >= params.floor).select("q", "r", "p")
    rows = rescorer(collective.collective_features(kept, s1, reference)).select("q", "r", "p")
    country = s1.select(F.col("entity_id").alias("q"), "country_key")
    return decision.decide(decision.ownership(rows).join(country, "q"), params)
