"""Queries of the llm problems over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.docpairs import describe_pairs, extract_units, newest
from graphloom.llm.handwritten import machine_made, text_profiles
from graphloom.llm.leaks import tile_leaks
from graphloom.llm.lookalike import lookalike_classes, lookalike_pairs, normalise
from graphloom.llm.mixing import Mix, count_tokens, mix_sources
from graphloom.llm.parsing import parse_texts, source_texts, unparsed_files
from graphloom.llm.terms import term_frequencies
from graphloom.runtime import staged
from graphloom.sources.tables import table


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, signature, description) of the functions and methods that are really documented."""
    nodes = newest(table(spark, d, "nodes"), "id", "updated_at", ["kind", "name", "docstring", "signature"])
    callable_ = nodes.where(F.lower(F.regexp_replace("kind", r"^\s+|\s+$", "")).isin("function", "method"))
    return describe_pairs(callable_, "id", "name", "docstring", "signature")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(id): functions and methods whose docstring tells something beyond the name."""
    return p2_pairs(spark, d).select("id")


def p2_snippet_units(spark: SparkSession, d: str) -> DataFrame:
    """Documented functions in the source texts among all documents, whatever source they are filed under."""
    return extract_units(source_texts(table(spark, d, "documents"), "text"), "doc_id", "text")


def p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every term of names and qualified names with occurrences, records and mark."""
    nodes = table(spark, d, "nodes").select("id", "name", "qualified_name")
    return term_frequencies(nodes, "id", ["name", "qualified_name"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(term, mark): terms too rare or too common."""
    return p3_term_counts(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def _newest_files(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "files"), "path", "indexed_at", ["language", "errors", "content_hash", "generated", "size", "node_count"])


def _unparsed(spark: SparkSession, d: str) -> DataFrame:
    return unparsed_files(_newest_files(spark, d).select("path", "language", "errors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(path): files that break their grammar or carry a foreign extension."""
    return _unparsed(spark, d).where("broken or foreign").select("path")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and language: files, flagged files and their rate."""
    return (
        _unparsed(spark, d)
        .groupBy("repository", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if("broken").alias("n_broken"), F.count_if("foreign").alias("n_foreign"), F.count_if(F.expr("broken or foreign")).alias("n_flagged"))
        .withColumn("rate", F.col("n_flagged") / F.col("n_files"))
    )


def p4_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Source texts among the documents, parsed against all grammars."""
    docs = source_texts(table(spark, d, "documents"), "text")
    return parse_texts(docs.withColumn("label", F.lit(None).cast("string")), "doc_id", "text", "label")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """(path, kind): files nobody wrote by hand."""
    return machine_made(_newest_files(spark, d), table(spark, d, "known_copies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(path): generated, minified, vendored or data-only files."""
    return p5_kinds(spark, d).select("path")


def p5_text_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Rule reuse, literals and shared rules of the source texts among the documents."""
    docs = source_texts(table(spark, d, "documents"), "text")
    return text_profiles(docs, "doc_id", "text", "project")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id): documents holding at least 15 consecutive words of an item."""
    leaks = tile_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_match=15)
    return leaks.where("longest >= 15").select("doc_id", "item_id").distinct()


def p6_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with reordered passages: tiles of 8 words on, kept if they cover half the item or one has 15 words."""
    leaks = tile_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_match=8)
    return leaks.where("coverage >= 0.5 or longest >= 15")


def _mix(spark: SparkSession, d: str) -> Mix:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    sized = staged(count_tokens(docs, "text"), "tokens")  # the sort below reads its input twice
    return mix_sources(sized, table(spark, d, "mix_targets"), "doc_id", "source", "tokens")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their tokens and the number of times each appears."""
    return _mix(spark, d).records.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source: target, budget and the share reached."""
    return _mix(spark, d).shares


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id_a, doc_id_b): documents with different stored texts that look the same."""
    pairs = lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document in the form its look-alikes share."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    formed = normalise(docs, "text", "text_form")
    return formed.select("doc_id", "text_form", (~F.col("text").eqNullSafe(F.col("text_form"))).alias("changed"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, class_id, n_rows, n_links): documents that have a look-alike, with their class and the number of these."""
    classes = lookalike_classes(table(spark, d, "documents"), "doc_id", "text").where("n_links > 0")
    return classes.select(F.col("id").alias("doc_id"), "class_id", "n_rows", "n_links")


QUERIES = {
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p2_snippet_units": p2_snippet_units,
    "p3_found": p3_found,
    "p3_term_counts": p3_term_counts,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p4_snippets": p4_snippets,
    "p5_found": p5_found,
    "p5_kinds": p5_kinds,
    "p5_text_profiles": p5_text_profiles,
    "p6_found": p6_found,
    "p6_tiles": p6_tiles,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_forms": p8_forms,
}

_TERMS = r"""
    WITH r AS (SELECT id, concat_ws(chr(10), max(name), max(qualified_name)) AS s
               FROM nodes WHERE id IS NOT NULL GROUP BY id),
    c AS (SELECT id, regexp_replace(regexp_replace(s, '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'),
                                    '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g') AS s FROM r),
    t AS (SELECT id, lower(unnest(regexp_extract_all(s, '[\p{L}\p{Nd}]+'))) AS term FROM c),
    f AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records
          FROM t WHERE regexp_matches(term, '\p{L}') GROUP BY term),
    m AS (SELECT term, occurrences, records,
                 CASE WHEN records < 3 THEN 'rare'
                      WHEN records > 0.05 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM f)
"""

SQL = {
    "p3_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p3_term_counts": _TERMS + "SELECT term, occurrences, records, mark FROM m",
}
