"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import data_queries, index_queries, pipeline_queries, relation_queries, search_queries

MODULES = [data_queries, index_queries, search_queries, relation_queries, pipeline_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.exact_search_topk(spark, sf_dir)
