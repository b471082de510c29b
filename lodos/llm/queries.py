"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, mixing, pieces, quality, secrets, sharding, simhash, suffix_dedup, telephony, training_order


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_telephony_audio": telephony.op4_telephony_audio,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_training_order": training_order.op7_training_order,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_mixing": mixing.op9_mixing,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.oracle_sql(),
        "op3_line_dedup": line_dedup.oracle_sql(),
        "op6_suffix_dedup": suffix_dedup.oracle_sql(),
        "op9_mixing": mixing.oracle_sql(),
        "op10_sharding": sharding.oracle_sql(),
    }
