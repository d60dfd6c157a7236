"""Interval, resolution, mining and specification queries over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import catalog as C
from graphloom.functions.names import is_generated_file, is_test_file
from graphloom.operators import intervals as I
from graphloom.operators import mining as M
from graphloom.operators import resolve as R
from graphloom.operators.spec import SpecGraph
from graphloom.runtime import staged
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


# ---- intervals ----------------------------------------------------------------------------------------------------

_MERGE = """{name}i AS (SELECT k, s, e, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM {of}),
    {name}j AS (SELECT k, s, e, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}i),
    {name} AS (SELECT k, min(s) AS s, max(e) AS e FROM {name}j GROUP BY k, g)"""


def _touched(spark, d):
    """Lines of each file that references stand on, two lines around."""
    refs = table(spark, d, "unresolved_refs").where("line is not null and trim(coalesce(file_path, '')) <> ''")
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    return refs.select(path.alias("path"), F.greatest(F.col("line") - 2, F.lit(1)).alias("start_line"), (F.col("line") + 2).alias("end_line"))


_TOUCHED = r"""tr AS (SELECT DISTINCT replace(file_path, '\', '/') AS k, greatest(line - 2, 1) AS s, line + 2 AS e FROM unresolved_refs WHERE line IS NOT NULL AND trim(coalesce(file_path, '')) <> ''), """


@query("WITH " + _TOUCHED + _MERGE.format(name="m", of="tr") + " SELECT k AS path, s AS start_line, e AS end_line FROM m")
def range_merge(spark, d):
    return I.merge_ranges(_touched(spark, d), "path")


@query(
    C.WITH
    + ", "
    + _TOUCHED
    + _MERGE.format(name="m", of="tr")
    + """ SELECT DISTINCT n.id, n.name, n.kind, n.file_path, n.start_line, n.end_line, n.end_line - n.start_line AS span FROM n JOIN m ON n.file_path = m.k
    WHERE n.start_line <= m.e AND m.s <= n.end_line AND n.start_line <= n.end_line AND n.kind NOT IN ('file', 'import', 'export', 'parameter', 'namespace')"""
)
def changed_symbols(spark, d):
    """Symbols whose span meets a touched range."""
    ranges = I.merge_ranges(_touched(spark, d), "path").select("path", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return I.changed_symbols(C.nodes(spark, d, "id", "name", "kind", "file_path", "start_line", "end_line"), ranges)


@query(
    C.WITH
    + ", "
    + _TOUCHED
    + """fs AS (SELECT file_path AS k, start_line AS s, end_line AS e FROM n WHERE kind IN ('function', 'method') AND start_line <= end_line), """
    + _MERGE.format(name="m", of="tr")
    + ", "
    + _MERGE.format(name="w", of="(SELECT DISTINCT * FROM fs)")
    + """, ln AS (SELECT k, unnest(range(s, e + 1)) AS x FROM w EXCEPT SELECT k, unnest(range(s, e + 1)) AS x FROM m),
    gr AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM ln) SELECT k AS file_path, min(x) AS start_line, max(x) AS end_line FROM gr GROUP BY k, g"""
)
def range_subtract(spark, d):
    """Lines of functions that no reference touches."""
    spans = C.nodes(spark, d, "kind", "file_path", "start_line", "end_line").where("kind in ('function', 'method') and file_path is not null")
    minus = I.merge_ranges(_touched(spark, d).withColumnRenamed("path", "file_path"), "file_path")
    return I.subtract_ranges(I.merge_ranges(spans, "file_path"), minus, "file_path").select("file_path", "start_line", "end_line")


@query(
    C.WITH
    + r""", pt AS (SELECT id AS point_id, replace(file_path, '\', '/') AS path, line FROM unresolved_refs WHERE line IS NOT NULL AND trim(coalesce(file_path, '')) <> '')
    SELECT point_id, path, line, (SELECT min_by(n.id, (n.end_line - n.start_line, n.start_line, n.id)) FROM n WHERE n.file_path = pt.path AND n.start_line <= pt.line AND pt.line <= n.end_line
    AND n.kind IN ('function', 'method', 'class', 'component')) AS scope_id FROM pt"""
)
def enclosing_scope(spark, d):
    """The narrowest symbol around each reference."""
    refs = table(spark, d, "unresolved_refs").where("line is not null and trim(coalesce(file_path, '')) <> ''")
    points = refs.select(F.col("id").alias("point_id"), F.replace("file_path", F.lit("\\"), F.lit("/")).alias("path"), "line")
    return I.enclosing_scope(C.nodes(spark, d, "id", "kind", "file_path", "start_line", "end_line"), points)


@query(
    C.WITH
    + r""", pt AS (SELECT id AS point_id, replace(file_path, '\', '/') AS path, line, reference_name AS nm FROM unresolved_refs WHERE line IS NOT NULL)
    SELECT point_id, min_by(n.id, (abs(n.start_line - pt.line) + abs(n.end_line - pt.line), n.id)) AS id FROM pt JOIN n ON n.file_path = pt.path AND n.name = pt.nm GROUP BY point_id"""
)
def nearest_symbol(spark, d):
    """For each reference the symbol of its name nearest by in its own file."""
    refs = table(spark, d, "unresolved_refs").where("line is not null")
    points = refs.select(F.col("id").alias("point_id"), F.replace("file_path", F.lit("\\"), F.lit("/")).alias("path"), "line", F.col("reference_name").alias("name"))
    return I.nearest_symbol(C.nodes(spark, d, "id", "name", "file_path", "start_line", "end_line"), points)


@query()
def diff_ranges(spark, d):
    """Changed ranges of the diffs among the reviews, under their project's name."""
    reviews = table(spark, d, "documents").where("source = 'reviews'")
    return I.diff_ranges(reviews, "doc_id", "text", "project")


# ---- resolution ---------------------------------------------------------------------------------------------------

_REF_LANGUAGE = """CASE lower(trim(u.language)) WHEN 'golang' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'c++' THEN 'cpp' WHEN 'c#' THEN 'csharp'
    ELSE coalesce(lower(trim(u.language)), 'unknown') END"""
_FAMILY = """CASE {c} WHEN 'java' THEN 'jvm' WHEN 'kotlin' THEN 'jvm' WHEN 'scala' THEN 'jvm' WHEN 'swift' THEN 'apple' WHEN 'objc' THEN 'apple' WHEN 'typescript' THEN 'web' WHEN 'tsx' THEN 'web'
    WHEN 'javascript' THEN 'web' WHEN 'jsx' THEN 'web' WHEN 'arkts' THEN 'web' WHEN 'c' THEN 'c' WHEN 'cpp' THEN 'c' WHEN 'csharp' THEN 'dotnet' WHEN 'razor' THEN 'dotnet' END"""
_REFS = (
    C.WITH
    + rf""", u AS (SELECT *, lower(trim(reference_kind)) AS rk FROM unresolved_refs WHERE reference_name IS NOT NULL AND trim(reference_name) <> ''),
    one AS (SELECT * FROM (SELECT u.*, {_REF_LANGUAGE} AS rl, row_number() OVER (PARTITION BY from_node_id, reference_name, rk, line, col ORDER BY id) AS rn FROM u) WHERE rn = 1),
    r AS (SELECT one.id AS ref_id, from_node_id, reference_name, rk AS reference_kind, one.line AS ref_line, one.col AS ref_col,
        CASE WHEN trim(coalesce(one.file_path, '')) = '' THEN n.file_path ELSE replace(one.file_path, '\', '/') END AS ref_path,
        CASE WHEN rl = 'unknown' THEN coalesce(n.language, rl) ELSE rl END AS ref_language, regexp_extract(reference_name, '([^.:>]*)$', 1) AS tail FROM one LEFT JOIN n ON one.from_node_id = n.id),
    nf AS (SELECT n.*, coalesce({_FAMILY.format(c="language")}, language) AS fam, {_FAMILY.format(c="language")} IS NOT NULL AS known FROM n),
    rf AS (SELECT r.*, coalesce({_FAMILY.format(c="ref_language")}, ref_language) AS rfam, {_FAMILY.format(c="ref_language")} IS NOT NULL AS rknown FROM r)"""
)
_GATE = "CASE WHEN reference_kind IN ('references', 'function_ref') THEN rfam = fam WHEN reference_kind = 'imports' THEN rfam = fam OR NOT (rknown AND known) ELSE true END"
_SHARED = """least(80, 15 * (SELECT count(*) FROM (SELECT unnest(range(1, len(da) + 1)) AS i) WHERE i <= len(db) AND da[1:i] = db[1:i]))"""


@query(_REFS + " SELECT ref_id, reference_name, reference_kind, ref_path, ref_language, tail FROM r")
def clean_references(spark, d):
    refs = R.clean_refs(table(spark, d, "unresolved_refs"), C.nodes(spark, d, "id", "file_path", "language"))
    return refs.select("ref_id", "reference_name", "reference_kind", "ref_path", "ref_language", "tail")


def _inputs(spark, d):
    nodes = C.nodes(spark, d, "id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "is_exported")
    nodes = staged(nodes, "symbols")
    return staged(R.clean_refs(table(spark, d, "unresolved_refs"), nodes), "refs"), nodes


@query(
    _REFS
    + f""", cand AS (SELECT rf.*, nf.id, nf.kind, nf.file_path, nf.language, nf.start_line, nf.is_exported FROM rf JOIN nf ON rf.reference_name = nf.name AND nf.kind <> 'import' WHERE {_GATE}),
    sz AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS total, max(CASE WHEN language = ref_language THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id) AS own FROM cand),
    dr AS (SELECT *, string_split(regexp_replace(ref_path, '/?[^/]*$', ''), '/') AS da, string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/') AS db FROM sz
           WHERE total <= 500 AND (own = 0 OR language = ref_language)),
    pr AS (SELECT *, coalesce({_SHARED}, 0) AS near FROM dr),
    sc AS (SELECT *, CASE WHEN file_path = ref_path THEN 100 ELSE 0 END + near + CASE WHEN language = ref_language THEN 50 ELSE -80 END
        + CASE WHEN reference_kind IN ('calls', 'decorates') AND kind IN ('function', 'method') THEN 25 WHEN reference_kind = 'instantiates' AND kind IN ('class', 'struct', 'interface') THEN 25
               WHEN reference_kind = 'decorates' AND kind IN ('class', 'interface') THEN 15 ELSE 0 END
        + CASE WHEN coalesce(is_exported, false) THEN 10 ELSE 0 END + CASE WHEN file_path = ref_path THEN coalesce(greatest(0, 20 - abs(start_line - ref_line) / 10.0), 0) ELSE 0 END AS score FROM pr),
    b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, file_path, start_line, id) AS rn FROM sc)
    SELECT ref_id, id AS target, CASE WHEN total = 1 THEN CASE WHEN language <> ref_language THEN 0.5 ELSE 0.9 END WHEN near >= 30 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM b WHERE rn = 1"""
)
def resolve_exact(spark, d):
    return R.by_exact_name(*_inputs(spark, d), ceiling=R.CEILING).select("ref_id", "target", "confidence")


@query(
    _REFS
    + """, q AS (SELECT * FROM r WHERE contains(reference_name, '::') OR contains(reference_name, '.')),
    fu AS (SELECT q.ref_id, count(*) AS c, max(CASE WHEN n.file_path = q.ref_path THEN 1 ELSE 0 END) AS own, min_by(n.id, (CASE WHEN n.file_path = q.ref_path THEN 0 ELSE 1 END, n.file_path, n.start_line, n.id)) AS target
           FROM q JOIN n ON q.reference_name = n.qualified_name GROUP BY q.ref_id),
    sure AS (SELECT ref_id, target, 0.95 AS confidence FROM fu WHERE c = 1 OR own = 1),
    su AS (SELECT q.ref_id, min_by(n.id, (CASE WHEN n.file_path = q.ref_path THEN 0 ELSE 1 END, n.file_path, n.start_line, n.id)) AS target FROM q JOIN n ON q.tail = n.name AND ends_with(n.qualified_name, q.reference_name)
           WHERE q.ref_id NOT IN (SELECT ref_id FROM sure) GROUP BY q.ref_id)
    SELECT ref_id, target, confidence::DOUBLE AS confidence FROM sure UNION ALL SELECT ref_id, target, 0.85::DOUBLE FROM su"""
)
def resolve_qualified(spark, d):
    return R.by_qualified_name(*_inputs(spark, d)).select("ref_id", "target", "confidence")


@query(
    _REFS
    + f""", c AS (SELECT rf.ref_id, rf.ref_language, nf.id, nf.language FROM rf JOIN nf ON lower(rf.reference_name) = lower(nf.name) AND nf.kind IN ('function', 'method', 'class') WHERE {_GATE}),
    g AS (SELECT ref_id, count(*) AS c, min(id) AS any_id, count(*) FILTER (WHERE language = ref_language) AS o, min(id) FILTER (WHERE language = ref_language) AS own_id FROM c GROUP BY ref_id)
    SELECT ref_id, coalesce(own_id, any_id) AS target, CASE WHEN o = 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM g WHERE o = 1 OR (o = 0 AND c = 1)"""
)
def resolve_fuzzy(spark, d):
    return R.by_fuzzy_name(*_inputs(spark, d)).select("ref_id", "target", "confidence")


def _strategy(name: str) -> str:
    """The part of a strategy's SQL after the shared tables, as one table of candidates."""
    sql = SQL[name]
    assert sql.startswith(_REFS)
    return "WITH RECURSIVE x_ AS (SELECT 1)" + sql[len(_REFS) :] if sql[len(_REFS) :].lstrip().startswith(",") else sql[len(_REFS) :]


_NEAR = _SHARED.replace("da", "string_split(regexp_replace(ref_path, '/?[^/]*$', ''), '/')").replace("db", "string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/')")
_RESOLVE_ALL = (
    _REFS
    + f""", q1 AS ({_strategy("resolve_qualified")}), q2 AS ({_strategy("resolve_exact").replace("total <= 500 AND ", "")}), q3 AS ({_strategy("resolve_fuzzy")}),
    fl AS (SELECT r.ref_id, n.id, CASE WHEN n.file_path = r.reference_name THEN 0.95 WHEN ends_with(n.file_path, '/' || r.reference_name) THEN 0.85 ELSE 0.7 END AS c, coalesce({_NEAR}, 0) AS near FROM r JOIN n ON n.kind = 'file'
      AND regexp_extract(r.reference_name, '([^/]*)$', 1) = regexp_extract(n.file_path, '([^/]*)$', 1) WHERE regexp_matches(r.reference_name, '\\.[A-Za-z]{{1,5}}$')),
    q4 AS (SELECT ref_id, min_by(id, (-c, -near, id)) AS target, max(c)::DOUBLE AS confidence FROM fl GROUP BY ref_id HAVING count(*) = 1 OR max(c) > 0.7),
    rc AS (SELECT *, regexp_extract(reference_name, '([A-Za-z0-9_]+)(?:\\.|::|->)[A-Za-z0-9_]+$', 1) AS receiver FROM r), ow AS (SELECT *, regexp_extract(qualified_name, '([A-Za-z0-9_]+)(?:\\.|::)[A-Za-z0-9_]+$', 1) AS owner FROM n WHERE kind IN ('method', 'function')),
    q5 AS (SELECT ref_id, min_by(id, (-coalesce({_NEAR}, 0), id)) AS target, 0.85::DOUBLE AS confidence FROM rc JOIN ow ON tail = name AND lower(receiver) = lower(owner) AND receiver <> '' AND ow.language = ref_language GROUP BY ref_id),
    al AS (SELECT *, 'qualified-name' AS resolved_by FROM q1 UNION ALL SELECT *, 'exact-match' FROM q2 UNION ALL SELECT *, 'fuzzy' FROM q3 UNION ALL SELECT *, 'file-path' FROM q4 UNION ALL SELECT *, 'member' FROM q5)
    SELECT ref_id, arg_min(target, (-confidence, resolved_by, target)) AS target, max(confidence) AS confidence, arg_min(resolved_by, (-confidence, resolved_by, target)) AS resolved_by FROM al GROUP BY ref_id"""
)


@query(_RESOLVE_ALL)
def resolve_all(spark, d):
    """Every reference with its most confident answer over all strategies."""
    return R.resolve(*_inputs(spark, d))


@query()
def resolved_edges(spark, d):
    """Edges that resolving adds, by kind and strategy."""
    refs, nodes = _inputs(spark, d)
    edges = R.edges_from(refs, R.resolve(refs, nodes), nodes)
    return edges.groupBy("kind", F.get_json_object("metadata", "$.resolvedBy").alias("resolved_by")).agg(F.count(F.lit(1)).alias("n"))


@query(_REFS + " SELECT reference_name, count(*) AS n_symbols FROM (SELECT DISTINCT reference_name FROM r) JOIN n ON reference_name = name AND kind <> 'import' GROUP BY reference_name HAVING count(*) > 500")
def ambiguous_names(spark, d):
    """Names of so many symbols that references to them stay open."""
    refs, nodes = _inputs(spark, d)
    counts = nodes.where("kind <> 'import'").groupBy("name").agg(F.count(F.lit(1)).alias("n_symbols")).where(F.col("n_symbols") > R.CEILING)
    asked = refs.select("reference_name").distinct()
    return counts.join(asked, F.col("name") == F.col("reference_name")).select("reference_name", "n_symbols")


# ---- commits ------------------------------------------------------------------------------------------------------

_MENTION = "`([A-Za-z_][A-Za-z0-9_]*)`"
_FILE = r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*/[A-Za-z0-9_-]+\.[A-Za-z][A-Za-z0-9]*"


def commits(spark, d):
    """Commits among the documents: message, symbols and files they mention, tickets, time."""
    docs = table(spark, d, "documents").where("source = 'commits' and text is not null")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("message"), F.unix_millis(F.col("created_at").cast("timestamp_ltz")).alias("ts_ms"),
        F.array_distinct(F.regexp_extract_all("text", F.lit(_MENTION), F.lit(1))).alias("symbols"), F.array_distinct(F.regexp_extract_all("text", F.lit(_FILE), F.lit(0))).alias("files"),
        M.ticket_refs(F.col("text")).alias("tickets"), "project",
    )


_COMMITS = f"""co AS (SELECT doc_id AS id, text AS message, epoch_us(created_at) // 1000 AS ts_ms, list_distinct(regexp_extract_all(text, '{_MENTION}', 1)) AS symbols,
    list_distinct(regexp_extract_all(text, '{_FILE}')) AS files, list_distinct(list_concat(regexp_extract_all(text, '[A-Z]+-[0-9]+'), regexp_extract_all(text, '#[0-9]+'))) AS tickets
    FROM documents WHERE source = 'commits' AND text IS NOT NULL)"""


@query(f"WITH {_COMMITS} SELECT id, len(symbols) AS n_symbols, len(files) AS n_files, len(tickets) AS n_tickets, len(symbols) / greatest(len(files), 1) AS cohesion FROM co")
def commit_features(spark, d):
    c = commits(spark, d)
    sizes = {f"n_{x}": F.size(x).cast("long") for x in ("symbols", "files", "tickets")}
    return c.select("id", *[e.alias(k) for k, e in sizes.items()], (F.size("symbols") / F.greatest(F.size("files"), F.lit(1))).alias("cohesion"))


@query(
    rf"WITH {_COMMITS} SELECT id, lower(regexp_extract(message, '^\w+\(([^)]*)\)!?:', 1)) AS scope FROM co WHERE (regexp_matches(message, '^(feat|fix|refactor|perf)(\([^)]*\))?!?:') OR NOT regexp_matches(message, '^\w+(\([^)]*\))?!?:')) AND NOT regexp_matches(message, '^(Revert|Reapply)\b')"
)
def commit_filter(spark, d):
    """Commits that tell about design, with their scope."""
    return commits(spark, d).where(M.design_relevant(F.col("message"))).select("id", M.scope_of(F.col("message")).alias("scope"))


_TFIDF = r"""w AS (SELECT id, list_filter(regexp_extract_all(lower(message), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3) AS words FROM co),
    ct AS (SELECT id, term, count(*) AS c, max(l) AS l FROM (SELECT id, unnest(words) AS term, len(words) AS l FROM w) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM ct GROUP BY term),
    ti AS (SELECT id, term, c / l * (ln(((SELECT count(*) FROM w) + 1) / (df + 1)) + 1) AS weight FROM ct JOIN df USING (term))"""


@query(f"WITH {_COMMITS}, {_TFIDF} SELECT id, term, round(weight, 8) AS weight FROM ti")
def tf_idf(spark, d):
    return M.tf_idf(commits(spark, d), "id", "message").select("id", "term", F.round("weight", 8).alias("weight"))


@query(
    f"""WITH {_COMMITS}, {_TFIDF}, nr AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM ti GROUP BY id),
    p AS (SELECT a.id AS a, b.id AS b FROM co a JOIN co b ON a.id < b.id),
    dt AS (SELECT p.a, p.b, sum(x.weight * y.weight) AS dot FROM p JOIN ti x ON x.id = p.a JOIN ti y ON y.id = p.b AND x.term = y.term GROUP BY p.a, p.b),
    cs AS (SELECT p.a, p.b, coalesce(dot / (na.norm * nb.norm), 0) AS cosine FROM p LEFT JOIN dt USING (a, b) LEFT JOIN nr na ON na.id = p.a LEFT JOIN nr nb ON nb.id = p.b),
    ft AS (SELECT *, len(symbols) / greatest(len(files), 1) AS coh, list_distinct(list_transform(files, lambda f: array_to_string(string_split(f, '/')[1:2], '/'))) AS dirs FROM co),
    j AS (SELECT cs.*, (0.6 + 0.4 * least(least(x.coh, y.coh) / 2.0, 1.0)) * (
        0.40 * CASE WHEN len(list_distinct(list_concat(x.symbols, y.symbols))) > 0 THEN len(list_intersect(x.symbols, y.symbols)) / len(list_distinct(list_concat(x.symbols, y.symbols))) ELSE 0 END
      + 0.15 * greatest(CASE WHEN len(list_distinct(list_concat(x.files, y.files))) > 0 THEN len(list_intersect(x.files, y.files)) / len(list_distinct(list_concat(x.files, y.files))) ELSE 0 END,
                        CASE WHEN len(list_distinct(list_concat(x.dirs, y.dirs))) > 0 THEN len(list_intersect(x.dirs, y.dirs)) / len(list_distinct(list_concat(x.dirs, y.dirs))) ELSE 0 END)
      + 0.25 * cosine + 0.10 * CASE WHEN len(list_distinct(list_concat(x.tickets, y.tickets))) > 0 THEN len(list_intersect(x.tickets, y.tickets)) / len(list_distinct(list_concat(x.tickets, y.tickets))) ELSE 0 END
      + 0.10 * exp(-abs(x.ts_ms - y.ts_ms) / 259200000.0)) AS score FROM cs JOIN ft x ON x.id = cs.a JOIN ft y ON y.id = cs.b)
    SELECT a, b, round(score, 6) AS score FROM j WHERE score >= 0.25"""
)
def commit_similarity(spark, d):
    """Pairs of like commits."""
    return M.commit_pairs(commits(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@query()
def commit_clusters(spark, d):
    """Communities of like commits."""
    return M.communities(M.commit_pairs(commits(spark, d))).select("id", "community")


@query()
def cluster_summary(spark, d):
    """Per community: commits, most mentioned files, time span; zero times do not count."""
    c = commits(spark, d)
    parts = M.communities(M.commit_pairs(c)).join(c.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"))
    ts = F.when(F.col("ts_ms") > 0, F.col("ts_ms"))
    return parts.groupBy("community").agg(F.count(F.lit(1)).alias("n_commits"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"), F.size(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("n_symbols"))


# ---- specifications -----------------------------------------------------------------------------------------------


def spec_graph(spark, d) -> SpecGraph:
    """Specs and commits among the documents.

    A commit belongs to the newest spec of its project and year; its fragments are
    the symbols it mentions and the files of its repository whose name it mentions.
    """
    docs = table(spark, d, "documents").where("source = 'specs' and text is not null")
    ts = F.unix_millis(F.col("created_at").cast("timestamp_ltz"))
    month = F.date_format("created_at", "yyyy")
    specs = docs.select(
        F.concat(F.lit("spec:"), F.col("doc_id").cast("string")).alias("id"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
        F.when(F.col("project").isNull(), "deprecated").otherwise("active").alias("status"), F.lit(1).alias("version"), F.concat(F.lit("specs/"), F.col("doc_id").cast("string")).alias("file_path"),
        ts.alias("ts_ms"), F.col("project").alias("s_project"), month.alias("s_month"),
    )
    newest = specs.groupBy("s_project", "s_month").agg(F.max_by("id", F.struct("ts_ms", "id")).alias("spec_id"))
    raw = table(spark, d, "documents").where("source = 'commits' and text is not null").select(F.col("doc_id").cast("string").alias("commit_hash"), "project", month.alias("month"))
    spec_commit = raw.join(newest, (F.col("project") == F.col("s_project")) & (F.col("month") == F.col("s_month"))).select("spec_id", "commit_hash")
    kind = F.when(F.pmod(F.col("commit_hash").cast("long"), F.lit(2)) == 0, "GENERATE").otherwise("SUMMARIZED_FROM")
    c = commits(spark, d)
    places = C.nodes(spark, d, "id", "kind", "name", "file_path", "start_line", "end_line")
    by_symbol = c.select(F.col("id").cast("string").alias("commit_hash"), F.explode("symbols").alias("name")).join(places, "name")
    files = places.where("kind = 'file'").withColumn("repository", F.substring_index("file_path", "/", 1))
    told = c.select(F.col("id").cast("string").alias("commit_hash"), F.col("project").alias("repository"), F.explode("files").alias("told")).withColumn("name", F.substring_index("told", "/", -1))
    met = by_symbol.drop("kind").unionByName(told.join(files, ["repository", "name"]).drop("told", "repository", "kind"))
    fragments = met.select("id", F.lit("MODIFY").alias("change_type"), "file_path", "start_line", "end_line").distinct()
    return SpecGraph(
        specs.drop("s_project", "s_month"), c.select(F.col("id").cast("string").alias("hash"), "message", "ts_ms"), fragments, spec_commit.withColumn("relation_type", kind),
        met.select("commit_hash", F.col("id").alias("fragment_id")).distinct(), spec_commit.select("spec_id", F.lit("").alias("other_id"), F.lit("").alias("relation_type")).limit(0),
    )


_SPECS = (
    C.WITH
    + f""", {_COMMITS}, sp AS (SELECT 'spec:' || doc_id AS id, regexp_extract(text, '^([^\\n]*)', 1) AS title, CASE WHEN project IS NULL THEN 'deprecated' ELSE 'active' END AS status,
    epoch_us(created_at) // 1000 AS ts_ms, project, strftime(created_at, '%Y') AS mon FROM documents WHERE source = 'specs' AND text IS NOT NULL),
    nw AS (SELECT project, mon, max_by(id, (ts_ms, id)) AS spec_id FROM sp GROUP BY project, mon),
    sc AS (SELECT spec_id, CAST(doc_id AS VARCHAR) AS commit_hash FROM documents dd JOIN nw ON dd.project = nw.project AND strftime(dd.created_at, '%Y') = nw.mon WHERE source = 'commits' AND text IS NOT NULL),
    cm AS (SELECT CAST(doc_id AS VARCHAR) AS commit_hash, project, list_distinct(regexp_extract_all(text, '{_MENTION}', 1)) AS symbols, list_distinct(regexp_extract_all(text, '{_FILE}')) AS files FROM documents WHERE source = 'commits' AND text IS NOT NULL),
    cf AS (SELECT commit_hash, n.id AS fragment_id, n.file_path AS f_path, n.start_line AS f_start, n.end_line AS f_end FROM (SELECT commit_hash, unnest(symbols) AS name FROM cm) JOIN n USING (name)
      UNION SELECT commit_hash, n.id, n.file_path, n.start_line, n.end_line FROM (SELECT commit_hash, project, string_split(unnest(files), '/')[-1] AS name FROM cm) t
      JOIN n ON n.name = t.name AND n.kind = 'file' AND string_split(n.file_path, '/')[1] = t.project),
    ch AS (SELECT sp.id AS spec_id, sp.title, sp.ts_ms, sc.commit_hash, cf.* EXCLUDE (commit_hash) FROM sp JOIN sc ON sp.id = sc.spec_id JOIN cf ON sc.commit_hash = cf.commit_hash WHERE status = 'active')"""
)


@query(
    _SPECS
    + """ SELECT 'specs_' || status AS metric, count(*) AS value FROM sp GROUP BY status UNION ALL SELECT 'commits', count(*) FROM co UNION ALL SELECT 'fragments', count(DISTINCT fragment_id) FROM cf
    UNION ALL SELECT 'spec_commit', count(*) FROM sc UNION ALL SELECT 'commit_fragment', count(*) FROM (SELECT DISTINCT commit_hash, fragment_id FROM cf) UNION ALL SELECT 'spec_spec', 0"""
)
def spec_stats(spark, d):
    return spec_graph(spark, d).stats()


@query(
    _SPECS
    + """ SELECT spec_id, count(DISTINCT fragment_id) AS n_fragments, count(DISTINCT commit_hash) AS n_commits, 1 AS path_level,
    max(greatest(least(f_end, 100) - greatest(f_start, 1) + 1, 0)) AS overlap_lines FROM ch WHERE contains(f_path, '/') GROUP BY spec_id"""
)
def spec_candidates(spark, d):
    """Active specs with fragments, with their figures for the first 100 lines."""
    return spec_graph(spark, d).candidates("/", 1, 100, None).select("spec_id", "n_fragments", "n_commits", "path_level", "overlap_lines")


@query(
    _SPECS
    + """, g AS (SELECT spec_id, title, ts_ms, max(greatest(least(f_end, 100) - greatest(f_start, 1) + 1, 0)) AS ov FROM ch WHERE contains(f_path, '/') GROUP BY spec_id, title, ts_ms),
    tl AS (SELECT DISTINCT spec_id FROM sc JOIN co ON CAST(co.id AS VARCHAR) = sc.commit_hash WHERE contains(lower(message), 'cache'))
    SELECT spec_id, round(0.30 * 0.6 + 0.25 * CASE WHEN spec_id IN (SELECT spec_id FROM tl) THEN 1 ELSE 0 END + 0.15 * CASE WHEN contains(lower(title), 'cache') THEN 1 ELSE 0 END
      + 0.20 / (1 + greatest((1767225600000 - ts_ms) / 86400000.0, 0) / 180) + 0.10 * least(1.0, ov / 100.0), 6) AS score FROM g"""
)
def spec_trace(spark, d):
    """The five-factor score of active specs for a place and a name, at the start of 2026."""
    return spec_graph(spark, d).trace("/", 1, 100, "cache", 1767225600000, 100_000).select("spec_id", F.round("score", 6).alias("score"))


@query(
    _SPECS
    + """, x AS (SELECT sc.spec_id, sc.commit_hash, CASE WHEN CAST(commit_hash AS BIGINT) % 2 = 0 THEN 'GENERATE' ELSE 'SUMMARIZED_FROM' END AS relation_type, co.ts_ms FROM sc JOIN co ON CAST(co.id AS VARCHAR) = sc.commit_hash),
    y AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY CASE relation_type WHEN 'GENERATE' THEN 0 ELSE 1 END, ts_ms DESC, commit_hash) AS rank FROM x) SELECT spec_id, commit_hash, relation_type, rank FROM y WHERE rank <= 5"""
)
def spec_context(spark, d):
    return spec_graph(spark, d).context()


@query(
    _SPECS
    + """, cp AS (SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+/[^/]+') AS p FROM f WHERE errors IS NOT NULL)
    SELECT DISTINCT spec_id FROM ch JOIN cp ON p <> '' AND f_path <> '' AND (contains(f_path, p) OR contains(p, f_path))"""
)
def affected_specs(spark, d):
    """Active specs with a fragment in a module of which a file was looked at for errors."""
    module = F.regexp_extract("path", r"^[^/]+/[^/]+/[^/]+", 0)
    return spec_graph(spark, d).affected_by(C.files(spark, d).where("errors is not null").select(module.alias("path")))


@query(
    C.WITH
    + r"""SELECT path, regexp_matches(path, '(^|/)(test_|[Tt]est\.)[^/]*$|[._-]([Tt]ests?|[Ss]pecs?)\.[A-Za-z0-9]+$|(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$|/(tests?|__tests__|specs?|testlib|testing|ohostest)/|^(tests?|specs?)/|(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/') AS is_test,
    regexp_matches(path, '(\.(pb|g|gen|generated|freezed|designer|Designer)\.[A-Za-z]+|_pb2(_grpc)?\.pyi?|_generated\.[a-z]+|\.min\.(js|mjs|css)|\.bundle\.js)$|/(__generated__|generated)/') AS is_generated FROM f"""
)
def file_predicates(spark, d):
    """Which files are tests and which carry a generator's name."""
    path = F.col("path")
    return C.files(spark, d).select("path", is_test_file(path).alias("is_test"), is_generated_file(path).alias("is_generated"))


@query(
    C.WITH
    + r"""SELECT language, count(*) AS n, count(*) FILTER (WHERE size > 1048576) AS n_oversize FROM f GROUP BY language"""
)
def oversize_files(spark, d):
    """Files above the size an indexer reads whole, per language."""
    return C.files(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 1_048_576).alias("n_oversize"))
