"""Streaming, extraction and composite queries over the stored tables, with their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import catalog as C
from graphloom.functions.code import dispatch_sites
from graphloom.operators import intervals as I
from graphloom.operators.imports import to_files
from graphloom.operators.resolve import clean_refs
from graphloom.operators.synthesize import request_type_routes, sites
from graphloom.operators import text as X
from graphloom.plans import context as P
from graphloom.plans.surveys import caller_inventory, conventional_handlers, declaration_sites, domain_files
from graphloom.runtime import shared_dir
from graphloom.sources.extract import extract
from graphloom.sources.files import generated_header, headings
from graphloom.sources.tables import table
from graphloom.streaming import changes as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n_events FROM g GROUP BY user_id, s"""


@query(_SESSIONS)
def debounce_sessions(spark, d):
    """Runs of a user's events without half an hour of quiet."""
    return S.sessions(table(spark, d, "events"), "user_id", "ts")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start_ts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return S.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def stream_changes(spark, d):
    """The change stream worked off once, batch by batch, into a table, and that table summed up."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = S.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")

    def land(batch, batch_id: int) -> None:
        batch.select("event_id", "user_id", "event_type").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    S.run_once(stream, land, f"{folder}/progress")
    landed = spark.read.parquet(f"{folder}/out")
    return landed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))


@query()
def extract_snippets(spark, d):
    """Graph rows found in the source texts among the documents, by type and kind."""
    docs = table(spark, d, "documents").where("source = 'snippets' and text is not null")
    language = F.when(F.col("text").rlike(r"(?m)^def "), "python").when(F.col("text").rlike(r"(?m)^func "), "go").otherwise("typescript")
    files = docs.select(F.concat(F.lit("snippets/"), F.col("doc_id").cast("string")).alias("path"), "text", language.alias("language"))
    return extract(files).groupBy("language", "row_type", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id AS id, CASE WHEN regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1) <> '' THEN regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1) ELSE trim(regexp_extract(text, '^\s*([^\n]*)', 1), ' ') END AS title,
    len(regexp_extract_all(text, '(?m)^##\s+(.+?)\s*$', 1)) AS n_subtitles FROM documents WHERE source = 'docs' AND text IS NOT NULL""")
def document_headings(spark, d):
    """Title and number of second-level headings of each manual page."""
    found = headings(table(spark, d, "documents").where("source = 'docs' and text is not null"), "doc_id", "text")
    return found.select("id", "title", F.size("subtitles").cast("long").alias("n_subtitles"))


@query()
def dispatch_scan(spark, d):
    """Calls that are bound at run time, in the source texts among the documents, comments read by each text's language."""

    def scan(batches):
        for pdf in batches:
            rows = [(p, form, line, text) for p, t, g in zip(pdf["path"], pdf["text"], pdf["language"]) for form, line, text in dispatch_sites(t, g)]
            yield pd.DataFrame(rows, columns=["path", "form", "line", "matched"])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("form", T.StringType()), T.StructField("line", T.LongType()), T.StructField("matched", T.StringType())])
    return _snippets(spark, d).mapInPandas(scan, schema)


@query(r"""SELECT doc_id, len(list_filter(string_split(left(text, 8192), chr(10))[1:60], lambda x: regexp_matches(x, '(?i)^[ \t\n\f\r\v]*(//|#|/?\*|--|;|<!--).*(code generated .* do not edit|@generated|auto-?generated|do not (edit|modify) (this file|by hand)|generated by)'))) > 0 AS generated
    FROM documents WHERE source = 'snippets' AND text IS NOT NULL""")
def header_scan(spark, d):
    """Whether a source text's first comments say that a tool wrote it."""
    docs = table(spark, d, "documents").where("source = 'snippets' and text is not null")
    return docs.select("doc_id", generated_header(F.col("text")).alias("generated"))


@query()
def explore_context(spark, d):
    """Symbols that a question about code needs."""
    kept, _ = P.context(C.nodes(spark, d), C.edges(spark, d), "How does `getToken` reach the render cache and who calls logger?")
    return kept.select("id", "kind", "name", "file_path", "depth", "is_root", F.round("score", 6).alias("score"))


@query()
def explore_files(spark, d):
    """Files worth reading from the routes on."""
    nodes, edges = C.nodes(spark, d), C.edges(spark, d)
    routes = nodes.where("kind = 'route'").select("id")
    named = X.exact_names(nodes, ["logger"]).select("id")
    return P.rank_files(nodes, edges, routes, named).select("file_path", "score", F.round("mass", 6).alias("mass"))


@query()
def diff_impact(spark, d):
    """What the lines that failed references stand on would touch."""
    refs = table(spark, d, "unresolved_refs").where("status = 'failed' and line is not null and trim(coalesce(file_path, '')) <> ''")
    lines = refs.select(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    ranges = I.merge_ranges(lines, "path").select("path", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return P.diff_impact(C.nodes(spark, d), C.edges(spark, d), ranges)


# ---- surveys, imports and what no name spells out ------------------------------------------------------------------


def _snippets(spark, d):
    docs = table(spark, d, "documents").where("source = 'snippets' and text is not null")
    language = F.when(F.col("text").rlike(r"(?m)^def "), "python").when(F.col("text").rlike(r"(?m)^func "), "go").otherwise("typescript")
    return docs.select(F.concat(F.lit("snippets/"), F.col("doc_id").cast("string")).alias("path"), "text", language.alias("language"))


@query(r"""SELECT 'snippets/' || doc_id AS path, line, text FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS text, unnest(range(1, len(regexp_split_to_array(text, '\r?\n')) + 1)) AS line
    FROM documents WHERE source = 'snippets' AND text IS NOT NULL) WHERE regexp_matches(text, '\b(?:class|interface|struct|enum|type|trait|const|let|var|def|func|fn|function|typedef|namespace)\s+stopProxy\b|\bid:\s*[''"]?stopProxy\b')""")
def survey_declarations(spark, d):
    """Lines of source texts that declare one name."""
    return declaration_sites(_snippets(spark, d), "stopProxy")


@query(
    C.WITH
    + """, h AS (SELECT file_path, sum(CASE WHEN contains(lower(name), 'cache') OR contains(lower(name), 'token') THEN CASE WHEN contains(lower(name), 'cache') THEN 1 ELSE 0 END + CASE WHEN contains(lower(name), 'token') THEN 1 ELSE 0 END + 2 ELSE 0 END) AS s,
    max(CASE WHEN contains(lower(file_path), 'cache') THEN 1 ELSE 0 END + CASE WHEN contains(lower(file_path), 'token') THEN 1 ELSE 0 END) AS p FROM n WHERE file_path IS NOT NULL GROUP BY file_path)
    SELECT file_path, CAST(s + 5 * p AS BIGINT) AS score FROM h WHERE s + 5 * p > 0"""
)
def survey_domain_files(spark, d):
    """Files about caches and tokens."""
    return domain_files(C.nodes(spark, d, "name", "file_path"), ["cache", "token"])


@query(
    C.WITH
    + """, nm AS (SELECT DISTINCT name FROM n WHERE kind = 'function'),
    fm AS (SELECT name, unnest(['on' || lower(name), 'handle' || lower(name), lower(name) || 'handler', 'do' || lower(name), 'on_' || lower(name), lower(name) || '_handler']) AS form FROM nm)
    SELECT DISTINCT fm.name, n.id, n.name AS handler FROM fm JOIN n ON fm.form = lower(n.name) AND n.kind IN ('function', 'method')"""
)
def survey_handlers(spark, d):
    """Callables that by convention handle what a function starts."""
    nodes = C.nodes(spark, d, "id", "kind", "name")
    return conventional_handlers(nodes, nodes.where("kind = 'function'").select("name"))


@query(
    C.WITH
    + """SELECT DISTINCT o.name AS type, m.name AS method, k.name AS caller, k.file_path AS caller_file FROM n o JOIN e c ON c.kind = 'contains' AND c.source = o.id JOIN n m ON c.target = m.id
    JOIN e x ON x.kind = 'calls' AND x.target = m.id JOIN n k ON x.source = k.id WHERE k.file_path <> o.file_path AND o.name IN (SELECT name FROM n WHERE kind = 'class')"""
)
def survey_callers(spark, d):
    """Who calls the members of classes from other files."""
    nodes, edges = C.nodes(spark, d, "id", "kind", "name", "file_path"), C.edges(spark, d, "source", "target", "kind")
    return caller_inventory(nodes, edges, nodes.where("kind = 'class'").select("name"), external=True)


@query()
def resolve_imports(spark, d):
    """Import references and the files they mean."""
    nodes = C.nodes(spark, d, "id", "kind", "name", "file_path", "language")
    return to_files(clean_refs(table(spark, d, "unresolved_refs"), nodes), nodes)


@query()
def synthesized_sites(spark, d):
    """Routes, observers, events and function pointers in the source texts among the documents, by role."""
    return sites(_snippets(spark, d)).groupBy("language", "role").agg(F.count(F.lit(1)).alias("n"))


@query()
def request_routes(spark, d):
    """Routes bound to methods by the type of their request."""
    return request_type_routes(C.nodes(spark, d, "id", "kind", "language", "qualified_name", "file_path", "start_line", "signature"))
