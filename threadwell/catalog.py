"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadwell.plans import search_queries, session_queries, transcript_queries  # noqa: F401  the others register their own


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: vector and text retrieval, fused, one hit for each session."""
    return search_queries.hybrid(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(search_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(search_queries.SQL)
