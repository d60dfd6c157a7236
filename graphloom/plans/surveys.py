"""Canned surveys of a code base: each a filter, a line scan or a join, and a ranked list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import base_name, directory
from graphloom.operators import graph as G


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text) of files (path, text)."""
    return files.where("text is not null").select("path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line_text")).select("path", (F.col("at") + 1).alias("line"), F.col("line_text").alias("text"))


def line_scan(files: DataFrame, pattern: str | Column) -> DataFrame:
    """(path, line, text) of the lines a regular expression matches; files without a match are skipped before they are split."""
    hit = files.where(F.col("text").rlike("(?m)" + pattern)) if isinstance(pattern, str) else files
    return lines_of(hit).where(F.col("text").rlike(pattern))


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def import_sites(files: DataFrame, modules: list[str]) -> DataFrame:
    """Import lines that name one of the modules."""
    return line_scan(files, rf"^\s*(?:import|from|export|#include|use|using|require)\b.*\b{_any(modules)}\b|require\(['\"][^'\"]*{_any(modules)}")


def api_usage(files: DataFrame, tokens: list[str]) -> DataFrame:
    """(path, n_lines, first_line, is_stub): files that use an API token, stubs last."""
    hits = line_scan(files, rf"\b{_any(tokens)}\b")
    out = hits.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line").alias("first_line"))
    return out.withColumn("is_stub", F.col("path").rlike(r"\.d\.ts$|\.pyi$|/stubs?/"))


def member_usage(files: DataFrame, member: str) -> DataFrame:
    """Lines that use a member or its literal name."""
    return line_scan(files, rf"(?:\.|->|::){re.escape(member)}\b|['\"]{re.escape(member)}['\"]")


def declaration_sites(files: DataFrame, name: str) -> DataFrame:
    """Lines that declare a type, value or binding of the name."""
    return line_scan(files, rf"\b(?:class|interface|struct|enum|type|trait|const|let|var|def|func|fn|function|typedef|namespace)\s+{re.escape(name)}\b|\bid:\s*['\"]?{re.escape(name)}\b")


def export_surface(files: DataFrame) -> DataFrame:
    """(path, line, name): names in native export tables of C and C++ files."""
    hits = line_scan(files.where(F.col("path").rlike(r"\.(?:c|cc|cpp|h|hpp)$")), r"(?:DECLARE_\w*FUNCTION|EXPORT_\w*|\{\s*\"\w+\"\s*,)")
    name = F.coalesce(F.nullif(F.regexp_extract("text", r"\"(\w+)\"", 1), F.lit("")), F.regexp_extract("text", r"\(\s*(\w+)", 1))
    return hits.select("path", "line", name.alias("name")).where("name <> ''")


def declaration_file_wraps(files: DataFrame) -> DataFrame:
    """(declaration, path, line): where a declaration file is imported by its name."""
    names = files.where(F.col("path").rlike(r"\.d\.ts$")).select(F.col("path").alias("declaration"), F.regexp_extract(base_name(F.col("path")), r"^(.+)\.d\.ts$", 1).alias("stem"))
    imports = line_scan(files, r"^\s*(?:import|export|declare module|///\s*<reference)").withColumn("told", F.regexp_extract("text", r"['\"](?:[^'\"]*/)?([\w.\-]+?)(?:\.d\.ts|\.d|\.ts)?['\"]", 1))
    return imports.join(names, F.col("told") == F.col("stem")).where("path <> declaration").select("declaration", "path", "line")


def caller_inventory(nodes: DataFrame, edges: DataFrame, types: list[str] | DataFrame, external: bool = False) -> DataFrame:
    """(type, method, caller, caller_file): who calls the methods of the named types (a list, or rows of name); ``external`` keeps other files' callers."""
    named_so = nodes.where(F.col("name").isin(types)) if isinstance(types, list) else nodes.join(types.select("name").distinct(), "name", "left_semi")
    owner = named_so.select(F.col("id").alias("o_id"), F.col("name").alias("type"), F.col("file_path").alias("o_path"))
    held = edges.where("kind = 'contains'").select(F.col("source").alias("c_s"), F.col("target").alias("c_t")).distinct()
    named = nodes.select(F.col("id").alias("m_id"), F.col("name").alias("method"))
    methods = owner.join(held, F.col("o_id") == F.col("c_s")).join(named, F.col("c_t") == F.col("m_id"))
    callers = nodes.select(F.col("id").alias("k_id"), F.col("name").alias("caller"), F.col("file_path").alias("caller_file"))
    out = edges.where("kind = 'calls'").join(methods, F.col("target") == F.col("m_id")).join(callers, F.col("source") == F.col("k_id"))
    out = out.where("caller_file <> o_path") if external else out
    return out.select("type", "method", "caller", "caller_file").distinct()


def type_dependencies(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """(from_type, to_type, n_links): links between the files of the named types."""
    at = nodes.where(F.col("name").isin(types)).select("name", "file_path").distinct()
    dep = G.file_dependencies(nodes, edges)
    a = at.select(F.col("name").alias("from_type"), F.col("file_path").alias("a_path"))
    b = at.select(F.col("name").alias("to_type"), F.col("file_path").alias("b_path"))
    met = dep.join(a, F.col("file_path") == F.col("a_path")).join(b, F.col("depends_on") == F.col("b_path")).where("from_type <> to_type")
    return met.groupBy("from_type", "to_type").agg(F.count(F.lit(1)).alias("n_links"))


def domain_symbols(nodes: DataFrame, words: list[str], roles: tuple[str, ...] = ("manager", "service", "controller", "store", "repository", "handler", "provider", "client")) -> DataFrame:
    """Types whose name holds a domain word, roles first."""
    low = F.lower("name")
    hits = sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))
    role = low.rlike(f"(?:{'|'.join(roles)})$").cast("int")
    return nodes.where("kind in ('class', 'interface', 'component', 'struct')").withColumn("score", hits * 10 + role * 5).where(hits > 0)


def domain_files(nodes: DataFrame, words: list[str]) -> DataFrame:
    """(file_path, score): two and the number of words for each symbol that holds one, five for each word in the path."""
    low, path = F.lower("name"), F.lower("file_path")
    hits = sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))
    in_path = sum((path.contains(w.lower()).cast("int") for w in words), F.lit(0))
    per = nodes.where("file_path is not null").groupBy("file_path").agg(F.sum(F.when(hits > 0, hits + 2).otherwise(0)).alias("s"), F.max(in_path).alias("p"))
    return per.select("file_path", (F.col("s") + 5 * F.col("p")).cast("long").alias("score")).where("score > 0")


def conventional_handlers(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id, handler): callables named onX, handleX, xHandler, doX or X_handler for each name (column name)."""
    want = names.select("name", F.lower(F.col("name")).alias("n")).distinct()
    forms = F.explode(F.array(F.concat(F.lit("on"), "n"), F.concat(F.lit("handle"), "n"), F.concat("n", F.lit("handler")), F.concat(F.lit("do"), "n"), F.concat(F.lit("on_"), "n"), F.concat("n", F.lit("_handler"))))
    asked = want.select("name", forms.alias("form"))
    have = nodes.where("kind in ('function', 'method')").select("id", F.col("name").alias("handler"))
    return asked.join(have, F.col("form") == F.lower("handler")).select("name", "id", "handler").distinct()


def named_cycles(nodes: DataFrame, edges: DataFrame, modules: list[str], least: int = 2) -> DataFrame:
    """Files on dependency cycles that touch at least ``least`` of the modules (folder names)."""
    dep = G.file_dependencies(nodes, edges)
    found = G.cycles(dep.select(F.col("file_path").alias("src"), F.col("depends_on").alias("dst")))
    leaf = base_name(directory(F.col("id")))
    touched = found.where(leaf.isin(modules)).groupBy("component").agg(F.countDistinct(leaf).alias("n")).where(F.col("n") >= least)
    return found.join(touched.select("component"), "component", "left_semi")


def config_files(files: DataFrame, most_bytes: int = 20_000) -> DataFrame:
    """Small manifests by their usual names."""
    names = r"(^|/)(package\.json|tsconfig[^/]*\.json|pyproject\.toml|setup\.cfg|Cargo\.toml|go\.mod|pom\.xml|build\.gradle(\.kts)?|[^/]*\.csproj|pubspec\.yaml|Makefile|CMakeLists\.txt|Dockerfile|oh-package\.json5|build-profile\.json5|module\.json5)$"
    return files.where(F.col("path").rlike(names) & (F.col("size") <= most_bytes))
