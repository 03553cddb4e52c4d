"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, jaccard_join, mixing, quality_classifier, quality_rules, secret_scan, suffix_dedup, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_sentencepiece": tokens.op3_sentencepiece,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": jaccard_join.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op9_exact_dedup": exact_dedup.SQL}
