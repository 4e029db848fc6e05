"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_automaton, capture_index, language_id, license_scan, line_dedup, ngram_join, pfair_mix, quality_mil, rule_cascade, topk_blocks


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_mil": quality_mil.query,
        "op2_capture_index": capture_index.query,
        "op3_language_id": language_id.query,
        "op4_rule_cascade": rule_cascade.query,
        "op5_pfair_mix": pfair_mix.query,
        "op6_topk_blocks": topk_blocks.query,
        "op7_bpe_automaton": bpe_automaton.query,
        "op8_license_scan": license_scan.query,
        "op9_line_dedup": line_dedup.query,
        "op10_ngram_join": ngram_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_capture_index": capture_index.ORACLE_SQL,
        "op4_rule_cascade": rule_cascade.ORACLE_SQL,
        "op6_topk_blocks": topk_blocks.ORACLE_SQL,
        "op8_license_scan": license_scan.ORACLE_SQL,
        "op10_ngram_join": ngram_join.ORACLE_SQL,
    }
