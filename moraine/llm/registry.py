"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, licenses, linedup, neardup, packing, ppm, quality, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": linedup.op1_line_dedup,
        "op2_threshold_topk": topk.op2_threshold_topk,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_chat_format": chat.op5_chat_format,
        "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_ppm_score": ppm.op9_ppm_score,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_threshold_topk": topk.ORACLE, "op4_quality_rules": quality.ORACLE}
