"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from quillon.llm import bpe, langid, lmscore, neardup, packing, quality, substring, topk, toxicity, urlfilter

QUERIES = {
    "op1_bpe_codec": bpe.op1_bpe_codec,
    "op2_language_id": langid.op2_language_id,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_minhash_near_dedup": neardup.op9_minhash_near_dedup,
    "op10_lm_score": lmscore.op10_lm_score,
}

ORACLES: dict[str, str] = {
    "op6_quality_rules": quality.ORACLE,
    "op7_exact_topk": topk.ORACLE,
}
