"""The clean graph behind the stored tables, and the SQL that defines the same.

nodes: newest row per id, spelling of kind, language and path evened out.
edges: one row per identity, both ends present (in the graph or the attached one).
files: newest row per path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import plain_kind, plain_language, plain_path
from graphloom.operators.store import dedup_edges, drop_orphans, newest
from graphloom.sources.tables import table

NODE_COLUMNS = (
    "id", "updated_at", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "docstring", "signature", "return_type",
    "is_exported", "decorators",
)


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Clean nodes with the given columns (all by default)."""
    wanted = [c for c in NODE_COLUMNS if not columns or c in columns or c in ("id", "updated_at")]
    raw = newest(table(spark, d, "nodes").select(*wanted), "id", "updated_at")
    fixes = {"kind": plain_kind(F.col("kind")), "language": plain_language(F.col("language")), "file_path": plain_path(F.col("file_path"))}
    out = raw.withColumns({c: e for c, e in fixes.items() if c in wanted})
    return out.select(*columns) if columns else out


def sdk_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sdk_nodes").withColumn("kind", plain_kind(F.col("kind")))


def all_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("id").unionByName(table(spark, d, "sdk_nodes").select("id"))


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Clean edges (all columns by default)."""
    raw = table(spark, d, "edges").select("id", "source", "target", plain_kind(F.col("kind")).alias("kind"), "line", "col", "metadata", "provenance")
    if columns:
        raw = raw.select(*dict.fromkeys(["id", "source", "target", "kind", "line", "col", *columns]))
    out = dedup_edges(drop_orphans(raw, all_ids(spark, d)))
    return out.select(*columns) if columns else out


def files(spark: SparkSession, d: str) -> DataFrame:
    raw = newest(table(spark, d, "files"), "path", "indexed_at")
    return raw.withColumn("path", plain_path(F.col("path"))).withColumn("language", plain_language(F.col("language")))


_LANGUAGE = """CASE lower(trim(language)) WHEN 'golang' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'
    WHEN 'c++' THEN 'cpp' WHEN 'c#' THEN 'csharp' ELSE coalesce(lower(trim(language)), 'unknown') END"""

#: The same tables in SQL: n (nodes), e (edges), f (files).
SQL_TABLES = rf"""
    n AS (SELECT id, updated_at, lower(trim(kind)) AS kind, name, qualified_name, replace(file_path, '\', '/') AS file_path, {_LANGUAGE} AS language,
                 start_line, end_line, docstring, signature, return_type, is_exported, decorators
          FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM nodes) WHERE rn = 1),
    ids AS (SELECT DISTINCT id FROM nodes UNION SELECT id FROM sdk_nodes),
    e AS (SELECT * EXCLUDE (rn) FROM (
              SELECT id, source, target, lower(trim(kind)) AS kind, line, col, metadata, provenance,
                     row_number() OVER (PARTITION BY source, target, lower(trim(kind)), line, col ORDER BY id) AS rn FROM edges)
          WHERE rn = 1 AND source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)),
    f AS (SELECT replace(path, '\', '/') AS path, content_hash, {_LANGUAGE} AS language, size, modified_at, indexed_at, node_count, errors, generated
          FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn FROM files) WHERE rn = 1)
"""
WITH = "WITH RECURSIVE " + SQL_TABLES
