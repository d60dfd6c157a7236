"""Queries of problem 1 over the stored tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.skew import heavy_hitters, per_key, skew_join
from graphloom.sources.tables import table

#: Share of a table's rows from which a key counts as heavy in p1_found.
FOUND_SHARE = 0.025


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, key): values holding at least 2.5 % of all stored rows of their table."""
    out = []
    for name, column in (("nodes", "name"), ("edges", "target")):
        df = table(spark, d, name).select(column)
        heavy, rows = heavy_hitters(df, column, FOUND_SHARE)
        counts = per_key(df, column, {"n": F.count(F.lit(1))}, heavy=heavy)
        out.append(
            counts.where(F.col(column).isNotNull() & (F.col("n") >= F.lit(FOUND_SHARE) * F.lit(rows))).select(
                F.lit(f"{name}.{column}").alias("field"), F.col(column).alias("key")
            )
        )
    return reduce(DataFrame.unionByName, out)


def p1_name_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol name: stored rows, distinct ids and files, line span."""
    df = table(spark, d, "nodes").select("name", "id", "file_path", "start_line", "end_line")
    return per_key(
        df,
        "name",
        {"n_rows": F.count(F.lit(1)), "last_line": F.max("end_line"), "first_line": F.min("start_line")},
        {"n_ids": "id", "n_files": "file_path"},
    )


def p1_target_fanin(spark: SparkSession, d: str) -> DataFrame:
    """Per edge target with the name of the node it points at: stored edges, distinct sources."""
    edges = table(spark, d, "edges").select("source", "target", "kind")
    names = table(spark, d, "nodes").groupBy("id").agg(F.max("name").alias("target_name"))
    names = names.unionByName(
        table(spark, d, "sdk_nodes").select("id", F.col("name").alias("target_name"))
    ).withColumnRenamed("id", "node_id")
    heavy, _ = heavy_hitters(edges, "target", 0.01)
    joined = skew_join(edges, names, "target", "node_id", "left", heavy=heavy)
    return per_key(
        joined,
        "target",
        {
            "target_name": F.max("target_name"),
            "n_edges": F.count(F.lit(1)),
            "n_calls": F.count_if(F.lower(F.trim("kind")) == "calls"),
        },
        {"n_sources": "source"},
        heavy=heavy,
    )


QUERIES = {"p1_found": p1_found, "p1_name_profile": p1_name_profile, "p1_target_fanin": p1_target_fanin}

SQL = {
    "p1_found": """
        SELECT 'nodes.name' AS field, name AS key FROM nodes WHERE name IS NOT NULL
        GROUP BY name HAVING count(*) >= 0.025 * (SELECT count(*) FROM nodes)
        UNION ALL
        SELECT 'edges.target' AS field, target AS key FROM edges WHERE target IS NOT NULL
        GROUP BY target HAVING count(*) >= 0.025 * (SELECT count(*) FROM edges)""",
    "p1_name_profile": """
        SELECT name, count(*) AS n_rows, max(end_line) AS last_line, min(start_line) AS first_line,
               count(DISTINCT id) AS n_ids, count(DISTINCT file_path) AS n_files
        FROM nodes GROUP BY name""",
    "p1_target_fanin": """
        WITH names AS (SELECT id, max(name) AS target_name FROM nodes GROUP BY id
                       UNION ALL SELECT id, name FROM sdk_nodes)
        SELECT e.target, max(n.target_name) AS target_name, count(*) AS n_edges,
               count(*) FILTER (WHERE lower(trim(e.kind)) = 'calls') AS n_calls,
               count(DISTINCT e.source) AS n_sources
        FROM edges e LEFT JOIN names n ON e.target = n.id GROUP BY e.target""",
}
