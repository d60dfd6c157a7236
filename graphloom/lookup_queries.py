"""Queries around the search over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import catalog as C
from graphloom import flow_queries as FQ
from graphloom import graph_queries as GQ
from graphloom import text_queries as TQ
from graphloom.functions.names import GENERATED_FILE, TEST_FILE
from graphloom.operators import lookup as L
from graphloom.operators import resolve as R
from graphloom.operators import text as X
from graphloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_LOW = f"(regexp_matches({{p}}, '{TEST_FILE}') OR regexp_matches({{p}}, '{GENERATED_FILE}'))"


@query(
    C.WITH
    + f""", r AS (SELECT file_path, count(*) AS n_routes FROM n WHERE kind = 'route' GROUP BY 1 ORDER BY n_routes DESC, file_path LIMIT 20),
    k AS (SELECT *, sum(n_routes) OVER () AS total, row_number() OVER (ORDER BY n_routes DESC, file_path) AS rn FROM r WHERE NOT {_LOW.format(p="file_path")})
    SELECT file_path, n_routes, CAST(total AS BIGINT) AS total FROM k WHERE rn = 1"""
)
def top_route_file(spark, d):
    """The production file with most routes, however few."""
    return L.top_route_file(C.nodes(spark, d, "kind", "file_path"), 1, 0.0)


@query(
    f"""WITH h AS ({GQ.SQL["route_handlers"].replace("WITH RECURSIVE", "WITH RECURSIVE", 1)}) SELECT handler_file, count(*) AS n_handlers FROM h WHERE NOT {_LOW.format(p="handler_file")}
    GROUP BY handler_file ORDER BY n_handlers DESC, handler_file LIMIT 1"""
)
def main_handler_file(spark, d):
    """The file that holds most handlers of routes."""
    return L.main_handler_file(GQ.route_handlers(spark, d))


@query(
    C.WITH
    + """SELECT array_to_string(string_split(path, '/')[1:i], '/') AS folder, CAST(i AS INT) AS depth, count(*) AS n_files, sum(size) AS bytes
    FROM (SELECT path, size, unnest(range(1, len(string_split(path, '/')))) AS i FROM f) GROUP BY 1, 2"""
)
def directory_rollup(spark, d):
    """Every folder with the files below it."""
    return L.directory_rollup(C.files(spark, d))


@query(C.WITH + "SELECT name, count(*) AS n_rows, count(DISTINCT (coalesce(file_path, chr(0)), coalesce(qualified_name, chr(0)))) AS n_groups FROM n GROUP BY name")
def definition_groups(spark, d):
    """Per name its symbols and the definitions they make."""
    return L.definition_groups(C.nodes(spark, d, "name", "file_path", "qualified_name"))


@query(
    C.WITH
    + """, h AS (SELECT id, name, file_path, row_number() OVER (PARTITION BY lower(name) ORDER BY file_path, start_line, id) AS rn FROM n WHERE lower(name) IN ('logger', 'value', 'gettoken', 'init'))
    SELECT id, name FROM h WHERE rn <= 10"""
)
def names_capped(spark, d):
    """Forty hits over four names, evenly."""
    hits = TQ.symbols(spark, d).where(F.lower("name").isin("logger", "value", "gettoken", "init")).select("id", "name", "file_path", "start_line")
    return L.capped_per_name(hits, 40, 4, F.col("file_path"), F.col("start_line"), F.col("id")).select("id", "name")


@query(C.WITH + "SELECT language, count(*) AS n, count(*) FILTER (WHERE kind = 'constant' AND language IN ('yaml', 'properties')) AS n_hidden, count(signature) FILTER (WHERE NOT (kind = 'constant' AND language IN ('yaml', 'properties'))) AS n_signatures FROM n GROUP BY language")
def config_values(spark, d):
    """Per language: symbols, keys whose values stay hidden, signatures that may be shown."""
    nodes = C.nodes(spark, d, "id", "kind", "language", "signature")
    leaf = L.config_leaf(F.col("kind"), F.col("language"))
    return L.without_values(nodes).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(leaf).alias("n_hidden"), F.count("signature").alias("n_signatures"))


@query(
    FQ._REFS
    + r""", pr AS (SELECT reference_name, unnest(list_concat([reference_name], list_filter(regexp_split_to_array(reference_name, '[.:$/>\-]+'), lambda x: x <> ''))) AS probe FROM (SELECT DISTINCT reference_name FROM r)
      UNION SELECT reference_name, upper(left(p1, 1)) || p1[2:] FROM (SELECT DISTINCT reference_name, list_filter(regexp_split_to_array(reference_name, '[.:$/>\-]+'), lambda x: x <> '') AS ps, list_filter(regexp_split_to_array(reference_name, '[.:$/>\-]+'), lambda x: x <> '')[1] AS p1 FROM r) WHERE len(ps) > 1)
    SELECT ref_id, reference_name FROM r WHERE reference_kind = 'imports' OR reference_name IN (SELECT reference_name FROM pr WHERE probe IN (SELECT name FROM n))"""
)
def answerable_references(spark, d):
    """References that some symbol could answer."""
    nodes = C.nodes(spark, d, "id", "name", "file_path", "language")
    return L.answerable(R.clean_refs(table(spark, d, "unresolved_refs"), nodes), nodes).select("ref_id", "reference_name")


_BUILTIN_ROWS = ", ".join(f"('{g}', '{w}')" for k, ws in L.BUILTINS.items() for g in ({"javascript": ("javascript", "typescript", "jsx", "tsx")}.get(k, (k,))) for w in ws.split())


@query(FQ._REFS + f", bi(bl, bn) AS (VALUES {_BUILTIN_ROWS}) SELECT ref_id, reference_name FROM r ANTI JOIN bi ON ref_language = bl AND regexp_extract(reference_name, '^([^.:>]*)', 1) = bn")
def foreign_references(spark, d):
    """References that name no built-in of their language."""
    nodes = C.nodes(spark, d, "id", "file_path", "language")
    refs = R.clean_refs(table(spark, d, "unresolved_refs"), nodes)
    return L.without_builtins(refs, L.default_builtins(spark)).select("ref_id", "reference_name")


def _asked(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", r"^[^\n]*", 0).alias("text"))
    return docs.select("query_id", F.explode(X.prose_words(F.col("text"))).alias("word"))


_RARE = TQ.SQL["segment_cooccurrence"].replace("strip_accents(text)", r"strip_accents(regexp_extract(text, '^[^\n]*'))")


@query(
    _RARE[: _RARE.rindex("SELECT query_id, name, count(DISTINCT word)")]
    + """, an AS (SELECT DISTINCT query_id FROM (SELECT query_id, name FROM v JOIN va USING (segment) GROUP BY query_id, name HAVING count(DISTINCT word) >= 2)),
    fw AS (SELECT segment, count(*) AS n_names FROM v GROUP BY segment HAVING count(*) BETWEEN 2 AND 25),
    rr AS (SELECT query_id, word, segment, row_number() OVER (PARTITION BY query_id ORDER BY n_names, segment, word) AS rn FROM va JOIN fw USING (segment) WHERE length(word) >= 5 AND query_id NOT IN (SELECT query_id FROM an)),
    hn AS (SELECT segment, v.name, row_number() OVER (PARTITION BY segment ORDER BY length(v.name), v.name) AS rn FROM v JOIN sg ON v.name = sg.name WHERE segment IN (SELECT segment FROM fw) AND len(list_distinct(s)) >= 2)
    SELECT query_id, word, rr.segment, hn.name FROM rr JOIN hn ON rr.segment = hn.segment WHERE rr.rn <= 2 AND hn.rn <= 12"""
)
def rare_words(spark, d):
    """For headlines of documents whose id 50 divides and that no name answers with two words: names with one of their rarest words."""
    vocabulary, asked = X.segment_vocabulary(TQ.symbols(spark, d)), _asked(spark, d)
    return L.rare_words(vocabulary, asked, X.segment_matches(vocabulary, asked))


@query()
def question_terms(spark, d):
    """Terms of the chats, compounds and stems among them, with the number of chats that have them."""
    chats = table(spark, d, "documents").where("source = 'chat' and text is not null").select("doc_id", F.explode(L.question_terms(F.col("text"))).alias("term"))
    return chats.groupBy("term").agg(F.count(F.lit(1)).alias("n_chats"))


@query()
def spec_search(spark, d):
    """Specifications for a few words, in three stages."""
    docs = table(spark, d, "documents").where("source = 'specs' and text is not null")
    specs = docs.select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.col("text").alias("body"), F.unix_millis(F.col("created_at").cast("timestamp_ltz")).alias("ts_ms"))
    return L.search_specs(specs, "cache table")
