"""Composite plans: what a question about code needs, and what a change touches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import is_generated_file, is_test_file, low_value_file
from graphloom.operators import graph as G
from graphloom.operators import intervals as I
from graphloom.operators import text as X
from graphloom.runtime import staged

# Words of prose that look like identifiers but name nothing.
COMMON = frozenset("the this that what where which when how why does with from into and for are not use used using code file function class method type name value".split())
#: Order in which a file's symbols are kept when its share is full.
KIND_ORDER = ("class", "interface", "component", "function", "method", "enum", "type_alias", "constant", "property", "field", "variable")


def symbols_in_prose(text: str) -> list[str]:
    """Identifiers a question names: quoted, dotted, camel or snake case, capitalised, called."""
    found = re.findall(r"`([^`]+)`", text) + re.findall(r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b|\b[A-Za-z]+(?:_[A-Za-z0-9]+)+\b|\b\w+(?=\()", text)
    found += [p for d in re.findall(r"\b\w+(?:(?:\.|::)\w+)+\b", text) for p in re.split(r"\.|::", d)]
    return list(dict.fromkeys(w for w in found if len(w) >= 3 and w.lower() not in COMMON))


def context(nodes: DataFrame, edges: DataFrame, question: str, roots: int = 10, depth: int = 1, most: int = 100, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(nodes with score, is_root, depth; edges among them) for a question.

    Channels: exact names with a bonus where they meet, prefix search over all
    words, near words by segments.  Tests count for 0.3, names that match several
    words for more.  The best become roots; their supertypes and neighbours
    follow; no file may take more than a fifth, none but production code more
    than 15 in a hundred; edges among what stays are recovered.
    """
    named = symbols_in_prose(question)
    words = [w for w in X.query_terms(question) if w not in COMMON and len(w) >= 3] or X.query_terms(question)
    exact = X.exact_names(nodes, named or words).select("id", (F.col("score") + 100).alias("score"))
    found = X.rescored(X.bm25(nodes, words), " ".join(words)).select("id", "score")
    best = exact.unionByName(found).groupBy("id").agg(F.max("score").alias("score"))
    low = F.lower("name")
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    ranked = nodes.join(best, "id").withColumn("n_words", hits)
    factor = F.when(is_test_file(F.col("file_path")), 0.3).otherwise(1.0) * F.when(F.col("n_words") >= 2, 1 + 0.5 * F.col("n_words")).otherwise(1.0)
    ranked = ranked.withColumn("score", F.col("score") * factor).where(F.col("score") >= least)
    root = staged(ranked.where("kind <> 'import'").orderBy(F.desc("score"), "id").limit(roots).select("id", "score"), "roots")
    kin = G.reach(G.adjacency(G.of_kinds(edges, G.SUPERTYPE), "both"), G.roots_of(root), 1).select("id", "depth")
    near = G.reach(G.adjacency(edges, "both"), G.roots_of(root), depth).select("id", "depth")
    around = kin.unionByName(near).groupBy("id").agg(F.min("depth").alias("depth"))
    picked = nodes.join(around, "id").join(root, "id", "left")
    priority = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")), F.lit(0))
    order = (F.asc("depth"), F.desc_nulls_last("score"), F.when(priority == 0, 99).otherwise(priority).asc(), F.asc("id"))
    per_file = Window.partitionBy("file_path").orderBy(*order)
    kept = picked.withColumn("in_file", F.row_number().over(per_file)).where((F.col("depth") == 0) | (F.col("in_file") <= max(5, most // 5)))
    off = low_value_file(F.col("file_path"))
    few = kept.where(off & (F.col("depth") > 0)).orderBy(*order).limit(max(3, most * 15 // 100))
    kept = kept.where(~off | (F.col("depth") == 0) | off.isNull()).unionByName(few).orderBy(*order).limit(most)
    kept = staged(kept.withColumn("is_root", F.col("depth") == 0).drop("in_file"), "context")
    glue = G.of_kinds(edges, ("calls", "extends", "implements", "references", "contains"))
    return kept, G.induced_edges(glue, kept).dropDuplicates(["source", "target", "kind"])


def rank_files(nodes: DataFrame, edges: DataFrame, entry: DataFrame, named: DataFrame, gate: float = 3.0) -> DataFrame:
    """(file_path, score, mass): files worth reading: 50 for a named symbol, 10 for an entry, 3 for a neighbour, then by walk mass."""
    near = G.reach(G.adjacency(edges, "both"), G.roots_of(entry), 1).where("depth > 0").select("id").distinct()
    points = named.select("id", F.lit(50.0).alias("p")).unionByName(entry.select("id", F.lit(10.0).alias("p"))).unionByName(near.select("id", F.lit(3.0).alias("p")))
    best = points.groupBy("id").agg(F.max("p").alias("p"))
    walk = G.random_walk(edges, entry)
    at = nodes.select("id", "file_path")
    per = at.join(best, "id").groupBy("file_path").agg(F.sum("p").alias("score"))
    mass = at.join(walk.withColumnRenamed("score", "m"), "id").groupBy(F.col("file_path").alias("m_path")).agg(F.sum("m").alias("mass"))
    out = per.join(mass, F.col("file_path") == F.col("m_path"), "left").select("file_path", "score", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    return out.where(F.col("score") >= gate).orderBy(is_generated_file(F.col("file_path")), F.desc("score"), F.desc("mass"), "file_path")


def diff_impact(nodes: DataFrame, edges: DataFrame, ranges: DataFrame, depth: int = 2, most_symbols: int = 80) -> DataFrame:
    """Changed symbols (narrowest ``most_symbols``) with the number of direct users and of symbols a change reaches.

    ``ranges`` has path, r_start and r_end.
    """
    changed = staged(I.changed_symbols(nodes, ranges).orderBy("span", "start_line", "name", "id").limit(most_symbols), "changed")
    users = G.callers(edges, changed, 1).groupBy(F.col("root").alias("u")).agg(F.count(F.lit(1)).alias("n_users"))
    reach = G.impact(edges, nodes, changed, depth).where("id <> root").groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("n_impacted"))
    out = changed.join(users, F.col("id") == F.col("u"), "left").join(reach, F.col("id") == F.col("r"), "left")
    return out.select("id", "name", "kind", "file_path", "start_line", "end_line", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_users", "n_impacted")])


def as_markdown(kept: DataFrame, edges: DataFrame, budget: int = 15_000) -> str:
    """The context as text, roots first, cut at a line within the budget; the context is bounded by its own limit."""
    lines = []
    for r in kept.orderBy(F.desc("is_root"), "file_path", "start_line").select("kind", "name", "file_path", "start_line", "signature", "docstring").collect():
        lines.append(f"### {r['kind']} {r['name']} ({r['file_path']}:{r['start_line']})")
        lines += [f"    {r['signature']}"] if r["signature"] else []
        lines += [r["docstring"].split("\n")[0]] if r["docstring"] and r["docstring"].strip() else []
    lines += [f"- {r['source']} {r['kind']} {r['target']}" for r in edges.select("source", "kind", "target").orderBy("source", "target", "kind").limit(200).collect()]
    text = "\n".join(lines)
    return text if len(text) <= budget else text[: text.rfind("\n", 0, budget)]


def as_json(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per symbol and edge, for sinks."""
    a = kept.select(F.lit("node").alias("what"), F.to_json(F.struct("id", "kind", "name", "file_path", "start_line", "is_root")).alias("json"))
    return a.unionByName(edges.select(F.lit("edge").alias("what"), F.to_json(F.struct("source", "target", "kind")).alias("json")))
