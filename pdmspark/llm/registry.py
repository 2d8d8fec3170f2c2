"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, hard_negatives, lm_scoring, mixing, sharding, simhash, spelling, substring_dedup, suffix_dedup, tokens, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_token_files": tokens.op2_token_files,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_simhash": simhash.op4_simhash,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_shard_interleaved": sharding.op7_shard_interleaved,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_lm_scores": lm_scoring.op12_lm_scores,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op3_mix_sources": mixing.SQL,
        "op6_url_filter": url_filter.SQL,
        "op7_shard_interleaved": sharding.SQL,
        "op9_decontamination": decontamination.SQL,
        "op11_spelling_variants": spelling.SQL,
        "op13_hard_negatives": hard_negatives.SQL,
    }
