"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import bpe, decontaminate, jaccard, lines, quality, quotes, rules, secrets, toxicity, urls

    return {
        "op1_url_filter": urls.op1_url_filter,
        "op2_quality": quality.op2_quality,
        "op3_quotation_links": quotes.op3_quotation_links,
        "op4_secrets": secrets.op4_secrets,
        "op5_quality_rules": rules.op5_quality_rules,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    from . import lines, quotes, rules

    return {
        "op3_quotation_links": quotes.ORACLE,
        "op5_quality_rules": rules.ORACLE,
        "op6_line_dedup": lines.ORACLE,
    }
