"""All queries of the core library and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom import flow_queries, graph_queries, lookup_queries, plan_queries, skew_queries, text_queries

_MODULES = (skew_queries, graph_queries, text_queries, flow_queries, plan_queries, lookup_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return graph_queries.impact_radius(spark, d)
