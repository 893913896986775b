"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvine.plans import data_queries, graph_queries, preparation, relational_queries, search_queries

MODULES = (preparation, graph_queries, relational_queries, search_queries, data_queries)

FLAGSHIP = "g_khop_down"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
