"""The registered queries of the text operators, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis_queries, letter_queries, token_queries

_MODULES = (letter_queries, token_queries, analysis_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_queries.readability_by_lang(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, (_, q) in m.QUERIES.items() if q}
