"""Collects the registered queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import classify_queries, pipeline_queries, report_queries, scalar_queries, search_queries, source_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (scalar_queries, search_queries, classify_queries, pipeline_queries, report_queries, source_queries)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over titles."""
    return search_queries.search_and_title(spark, sf_dir)
