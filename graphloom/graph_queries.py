"""Graph and store queries over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import catalog as C
from graphloom.functions.names import is_test_file, node_id, plain_path
from graphloom.operators import graph as G
from graphloom.operators import store as S
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


def kind_ids(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return C.nodes(spark, d, "id", "kind").where(F.col("kind") == kind).select("id")


def rows():
    return F.count(F.lit(1))


@query(C.WITH + "SELECT kind, count(*) AS n FROM n GROUP BY kind")
def nodes_by_kind(spark, d):
    return C.nodes(spark, d, "kind").groupBy("kind").agg(rows().alias("n"))


@query(C.WITH + "SELECT kind, count(*) AS n FROM e GROUP BY kind")
def edges_by_kind(spark, d):
    return C.edges(spark, d, "kind").groupBy("kind").agg(rows().alias("n"))


@query(C.WITH + "SELECT language, count(*) AS n, sum(size) AS bytes FROM f GROUP BY language")
def files_by_language(spark, d):
    return C.files(spark, d).groupBy("language").agg(rows().alias("n"), F.sum("size").alias("bytes"))


@query(
    C.WITH
    + """SELECT 'nodes' AS metric, count(*) AS value FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'files', count(*) FROM f
    UNION ALL SELECT 'pending_refs', count(*) FROM unresolved_refs WHERE status = 'pending' UNION ALL SELECT 'failed_refs', count(*) FROM unresolved_refs WHERE status = 'failed'
    UNION ALL SELECT 'last_indexed_ms', epoch_us(max(indexed_at)) // 1000 FROM f"""
)
def graph_stats(spark, d):
    """Counts of the whole graph and the newest indexing time."""

    def one(df: DataFrame, metric: str, value=None) -> DataFrame:
        return df.agg((rows() if value is None else value).alias("value")).select(F.lit(metric).alias("metric"), "value")

    refs, files = table(spark, d, "unresolved_refs"), C.files(spark, d)
    parts = [
        one(C.nodes(spark, d, "id"), "nodes"), one(C.edges(spark, d, "id"), "edges"), one(files, "files"),
        one(refs.where("status = 'pending'"), "pending_refs"), one(refs.where("status = 'failed'"), "failed_refs"),
        one(files, "last_indexed_ms", F.unix_millis(F.max("indexed_at").cast("timestamp_ltz"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(C.WITH + "SELECT id, source, target, kind, line, col FROM e")
def edge_identity(spark, d):
    """Edges after identity dedup and orphan removal."""
    return C.edges(spark, d, "id", "source", "target", "kind", "line", "col")


@query("""SELECT count(*) AS stored, count(*) FILTER (WHERE NOT ok) AS orphans FROM (
    SELECT source IN (SELECT id FROM nodes UNION SELECT id FROM sdk_nodes) AND target IN (SELECT id FROM nodes UNION SELECT id FROM sdk_nodes) AS ok FROM edges)""")
def orphan_edges(spark, d):
    edges = table(spark, d, "edges").select("id", "source", "target")
    sound = S.drop_orphans(edges, C.all_ids(spark, d)).agg(rows().alias("sound"))
    return edges.agg(rows().alias("stored")).crossJoin(F.broadcast(sound)).select("stored", (F.col("stored") - F.col("sound")).alias("orphans"))


@query(
    C.WITH
    + r"""SELECT id, kind || ':' || left(sha256(concat_ws(':', file_path, kind, name, CAST(start_line AS VARCHAR))), 32) AS computed FROM n"""
)
def node_id_hash(spark, d):
    nodes = C.nodes(spark, d, "id", "kind", "file_path", "name", "start_line")
    return nodes.select("id", node_id(F.col("kind"), F.col("file_path"), F.col("name"), F.col("start_line")).alias("computed"))


@query(C.WITH + "SELECT DISTINCT s.file_path, t.file_path AS depends_on FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE e.kind <> 'contains' AND s.file_path <> t.file_path")
def file_dependencies(spark, d):
    return G.file_dependencies(C.nodes(spark, d, "id", "file_path"), C.edges(spark, d, "source", "target", "kind"))


@query(
    C.WITH
    + """SELECT t.file_path, count(DISTINCT s.file_path) AS n_dependents FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id
    WHERE e.kind <> 'contains' AND s.file_path <> t.file_path GROUP BY t.file_path"""
)
def file_dependents(spark, d):
    links = G.file_dependencies(C.nodes(spark, d, "id", "file_path"), C.edges(spark, d, "source", "target", "kind"))
    return links.groupBy(F.col("depends_on").alias("file_path")).agg(rows().alias("n_dependents"))


@query(
    C.WITH
    + """, c AS (SELECT s.file_path, count(*) AS n_edges FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE s.file_path = t.file_path GROUP BY 1),
    r AS (SELECT *, lead(n_edges) OVER (ORDER BY n_edges DESC, file_path) AS runner_up, row_number() OVER (ORDER BY n_edges DESC, file_path) AS rn FROM c)
    SELECT file_path, n_edges, runner_up FROM r WHERE rn = 1 AND n_edges >= 1"""
)
def dominant_file(spark, d):
    return G.dominant_file(C.nodes(spark, d, "id", "file_path"), C.edges(spark, d, "source", "target"), 1)


@query(
    C.WITH
    + """, r AS (SELECT file_path, count(*) AS n_routes FROM n WHERE kind = 'route' GROUP BY 1)
    SELECT file_path, n_routes, n_routes / (SELECT sum(n_routes) FROM r) AS share FROM r"""
)
def route_files(spark, d):
    """Routes per file with their share of all routes."""
    per_file = C.nodes(spark, d, "file_path", "kind").where("kind = 'route'").groupBy("file_path").agg(rows().alias("n_routes"))
    total = per_file.agg(F.sum("n_routes").alias("total"))
    return per_file.crossJoin(F.broadcast(total)).select("file_path", "n_routes", (F.col("n_routes") / F.col("total")).alias("share"))


@query(
    C.WITH
    + """SELECT r.name AS route, r.file_path AS route_file, h.name AS handler, h.file_path AS handler_file, e.kind FROM e JOIN n r ON e.source = r.id AND r.kind = 'route'
    JOIN n h ON e.target = h.id AND h.kind IN ('function', 'method', 'class') WHERE e.kind IN ('references', 'calls')"""
)
def route_handlers(spark, d):
    """Routes with the symbols that handle them."""
    nodes = C.nodes(spark, d, "id", "kind", "name", "file_path")
    r = nodes.where("kind = 'route'").select(F.col("id").alias("r_id"), F.col("name").alias("route"), F.col("file_path").alias("route_file"))
    h = nodes.where("kind in ('function', 'method', 'class')").select(F.col("id").alias("h_id"), F.col("name").alias("handler"), F.col("file_path").alias("handler_file"))
    edges = C.edges(spark, d, "source", "target", "kind").where("kind in ('references', 'calls')")
    joined = edges.join(r, F.col("source") == F.col("r_id")).join(h, F.col("target") == F.col("h_id"))
    return joined.select("route", "route_file", "handler", "handler_file", "kind")


@query(
    C.WITH
    + """SELECT n.id, n.name, n.file_path FROM n WHERE kind IN ('function', 'method', 'class') AND NOT coalesce(is_exported, false)
    AND id NOT IN (SELECT target FROM e WHERE kind <> 'contains')"""
)
def dead_code(spark, d):
    nodes = C.nodes(spark, d, "id", "kind", "name", "file_path", "is_exported")
    return G.dead_code(nodes, C.edges(spark, d, "target", "kind")).select("id", "name", "file_path")


@query(
    C.WITH
    + """, p AS (SELECT target AS child, min_by(source, id) AS parent FROM e WHERE kind = 'contains' GROUP BY target),
    a(root, id, depth) AS (SELECT id, id, 0 FROM n UNION SELECT root, parent, depth + 1 FROM a JOIN p ON a.id = p.child WHERE depth < 1000),
    dd AS (SELECT root, max(depth) AS depth FROM (SELECT root, id, min(depth) AS depth FROM a GROUP BY root, id) GROUP BY root),
    i AS (SELECT target AS id, count(*) AS incoming, count(*) FILTER (WHERE kind = 'calls') AS callers FROM e GROUP BY target),
    o AS (SELECT source AS id, count(*) AS outgoing, count(*) FILTER (WHERE kind = 'calls') AS calls, count(*) FILTER (WHERE kind = 'contains') AS children FROM e GROUP BY source)
    SELECT n.id, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers,
           coalesce(children, 0) AS children, CAST(depth AS BIGINT) AS depth FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN dd ON n.id = dd.root"""
)
def node_metrics(spark, d):
    return G.node_metrics(C.nodes(spark, d, "id"), C.edges(spark, d, "id", "source", "target", "kind"))


@query(
    C.WITH
    + """SELECT e.id, e.source, e.target, e.kind FROM e WHERE source IN (SELECT id FROM n WHERE kind IN ('class', 'interface'))
    AND target IN (SELECT id FROM n WHERE kind IN ('class', 'interface'))"""
)
def induced_edges(spark, d):
    """Edges among classes and interfaces."""
    types = C.nodes(spark, d, "id", "kind").where("kind in ('class', 'interface')")
    return G.induced_edges(C.edges(spark, d, "id", "source", "target", "kind"), types)


@query(C.WITH + r", g AS (SELECT *, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM n) SELECT CASE dir WHEN '' THEN '.' ELSE dir END AS directory, count(DISTINCT file_path) AS n_files, count(*) AS n_symbols FROM g GROUP BY 1")
def module_structure(spark, d):
    return G.module_structure(C.nodes(spark, d, "file_path"))


@query(C.WITH + "SELECT target AS id, source AS used_by, kind, line FROM e WHERE target IN (SELECT id FROM n WHERE kind = 'interface')")
def usages(spark, d):
    """All incoming edges of every interface."""
    edges, ids = C.edges(spark, d, "source", "target", "kind", "line"), kind_ids(spark, d, "interface")
    return edges.join(ids.select(F.col("id").alias("i_id")), F.col("target") == F.col("i_id"), "left_semi").select(F.col("target").alias("id"), F.col("source").alias("used_by"), "kind", "line")


@query(C.WITH + "SELECT DISTINCT source AS parent, target AS child FROM e WHERE kind = 'contains'")
def children(spark, d):
    return G.children(C.edges(spark, d, "source", "target", "kind"))


@query(C.WITH + "SELECT file_path, count(*) AS n_exported, min(name) AS first_name FROM n WHERE is_exported GROUP BY file_path")
def exported_symbols(spark, d):
    exported = C.nodes(spark, d, "file_path", "name", "is_exported").where("is_exported")
    return exported.groupBy("file_path").agg(rows().alias("n_exported"), F.min("name").alias("first_name"))


@query(C.WITH + r"SELECT id, qualified_name FROM n WHERE regexp_matches(qualified_name, '^.*::.*Map$') AND kind IN ('class', 'function', 'method', 'interface', 'type_alias', 'variable', 'constant')")
def qualified_glob(spark, d):
    kinds = ("class", "function", "method", "interface", "type_alias", "variable", "constant")
    nodes = C.nodes(spark, d, "id", "qualified_name", "kind").where(F.col("kind").isin(*kinds))
    return G.qualified_glob(nodes, "*::*Map").select("id", "qualified_name")


@query(C.WITH + r"SELECT path, language FROM f WHERE regexp_matches(path, 'src/[^/]*/core/.*\.py') AND starts_with(path, 'atlas-mono')")
def file_listing(spark, d):
    """Files under a prefix that match a glob."""
    return G.file_glob(C.files(spark, d).where(F.col("path").startswith("atlas-mono")), "src/*/core/**.py").select("path", "language")


def _reach_sql(links: str, roots: str, depth: int, tail: str = "SELECT root, id, min(depth) AS depth FROM r GROUP BY root, id HAVING min(depth) > 0", extra: str = "") -> str:
    return (
        C.WITH
        + f", {extra} l AS (SELECT DISTINCT * FROM ({links})), r(root, id, depth) AS (SELECT id, id, 0 FROM ({roots}) UNION SELECT r.root, l.dst, r.depth + 1 FROM r JOIN l ON r.id = l.src WHERE r.depth < {depth}) {tail}"
    )


_CAPPED = "capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS cr FROM e WHERE kind IN ('calls', 'references', 'imports', 'instantiates')) WHERE cr <= 250),"
_USES = "e WHERE kind IN ('calls', 'references', 'imports', 'instantiates')"


@query(_reach_sql("SELECT target AS src, source AS dst FROM capped", "SELECT id FROM n WHERE kind = 'interface'", 1, extra=_CAPPED))
def callers_1hop(spark, d):
    return G.callers(C.edges(spark, d, "id", "source", "target", "kind"), kind_ids(spark, d, "interface"))


@query(_reach_sql("SELECT target AS src, source AS dst FROM capped", "SELECT id FROM n WHERE kind = 'component'", 2, extra=_CAPPED))
def callers_2hop(spark, d):
    return G.callers(C.edges(spark, d, "id", "source", "target", "kind"), kind_ids(spark, d, "component"), 2)


@query(_reach_sql(f"SELECT source AS src, target AS dst FROM {_USES}", "SELECT id FROM n WHERE kind = 'route'", 2))
def callees_2hop(spark, d):
    return G.callees(C.edges(spark, d, "source", "target", "kind"), kind_ids(spark, d, "route"), 2)


@query(
    _reach_sql(
        "SELECT target AS src, source AS dst FROM capped", "SELECT id FROM n WHERE kind = 'enum'", 2,
        """, r2(root, id, depth) AS (SELECT id, id, 0 FROM n WHERE kind = 'enum' UNION SELECT r2.root, e.target, r2.depth + 1 FROM r2 JOIN e ON r2.id = e.source
           WHERE r2.depth < 2 AND e.kind IN ('calls', 'references', 'imports', 'instantiates'))
           SELECT id AS root, id, 'focal' AS role FROM n WHERE kind = 'enum' UNION ALL SELECT root, id, 'caller' FROM r GROUP BY root, id HAVING min(depth) > 0
           UNION ALL SELECT root, id, 'callee' FROM r2 GROUP BY root, id HAVING min(depth) > 0""", _CAPPED,
    )
)
def call_graph(spark, d):
    return G.call_graph(C.edges(spark, d, "id", "source", "target", "kind"), kind_ids(spark, d, "enum"))


@query(_reach_sql("SELECT source AS src, target AS dst FROM e UNION ALL SELECT target, source FROM e", "SELECT min(id) AS id FROM n WHERE kind = 'route'", 3, "SELECT id, min(depth) AS depth FROM r GROUP BY id"))
def bfs_depth3(spark, d):
    """Everything within three steps, either way, of the first route."""
    root = kind_ids(spark, d, "route").agg(F.min("id").alias("id"))
    return G.reach(G.adjacency(C.edges(spark, d, "source", "target"), "both"), G.roots_of(root), 3).select("id", "depth")


_IMPACT_MEMBERS = "m AS (SELECT DISTINCT e.source AS src, e.target AS dst FROM e JOIN n c ON e.source = c.id WHERE e.kind = 'contains' AND c.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum'))"
_IMPACT = (
    C.WITH
    + f""", {_IMPACT_MEMBERS},
    x AS (SELECT src, dst, 0 AS cost FROM m UNION SELECT target, source, 1 FROM e WHERE kind <> 'contains'),
    r(root, id, depth) AS (SELECT id, id, 0 FROM n WHERE kind = 'type_alias' UNION SELECT r.root, x.dst, r.depth + x.cost FROM r JOIN x ON r.id = x.src WHERE r.depth < 3)
    SELECT root, id, min(depth) AS depth FROM r GROUP BY root, id"""
)


@query(_IMPACT)
def impact_radius(spark, d):
    nodes, edges = C.nodes(spark, d, "id", "kind"), C.edges(spark, d, "source", "target", "kind")
    return G.impact(edges, nodes, kind_ids(spark, d, "type_alias"))


@query(
    C.WITH
    + """, l AS (SELECT DISTINCT source AS src, target AS dst FROM e),
    r(root, id, depth) USING KEY (root, id) AS (SELECT id, id, 0 FROM n WHERE kind = 'route' AND start_line % 5 = 0
      UNION SELECT DISTINCT r.root, l.dst, r.depth + 1 FROM r JOIN l ON r.id = l.src LEFT JOIN recurring.r AS known ON known.root = r.root AND known.id = l.dst WHERE known.id IS NULL)
    SELECT root AS source, r.id AS target, depth AS hops FROM r JOIN n ON r.id = n.id AND n.kind IN ('function', 'method', 'class', 'interface')"""
)
def shortest_path(spark, d):
    """Hops from the routes on every fifth line to all functions, methods and types, however far."""
    nodes = staged(C.nodes(spark, d, "id", "kind", "start_line").where("kind in ('route', 'function', 'method', 'class', 'interface')"), "symbols")
    starts = nodes.where("kind = 'route' and start_line % 5 = 0").select("id")
    ends = nodes.where("kind in ('function', 'method', 'class', 'interface')").select("id")
    paths = G.shortest_paths(table(spark, d, "edges"), sources=starts, targets=ends, paths=False, known=C.all_ids(spark, d))
    return paths.select("source", "target", "hops")


@query(
    C.WITH
    + """, k AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE kind IN ('extends', 'implements')),
    u(root, id) AS (SELECT id, id FROM n WHERE kind = 'class' UNION SELECT u.root, k.dst FROM u JOIN k ON u.id = k.src),
    w(root, id) AS (SELECT id, id FROM n WHERE kind = 'class' UNION SELECT w.root, k.src FROM w JOIN k ON w.id = k.dst)
    SELECT root, id, 'ancestor' AS relation FROM u WHERE root <> id UNION ALL SELECT root, id, 'descendant' FROM w WHERE root <> id"""
)
def type_hierarchy(spark, d):
    return G.type_hierarchy(C.edges(spark, d, "source", "target", "kind"), kind_ids(spark, d, "class")).select("root", "id", "relation")


@query(
    C.WITH
    + """, p AS (SELECT target AS child, min_by(source, id) AS parent FROM e WHERE kind = 'contains' GROUP BY target),
    a(root, id, depth) AS (SELECT id, id, 0 FROM n WHERE kind = 'field' UNION SELECT root, parent, depth + 1 FROM a JOIN p ON a.id = p.child WHERE depth < 1000)
    SELECT root, id, min(depth) AS depth FROM a GROUP BY root, id HAVING min(depth) > 0"""
)
def ancestors(spark, d):
    return G.ancestors(C.edges(spark, d, "id", "source", "target", "kind"), kind_ids(spark, d, "field"))


_DEPENDS = "dep AS (SELECT DISTINCT s.file_path AS a, t.file_path AS b FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE e.kind <> 'contains' AND s.file_path <> t.file_path)"
_TEST = r"(^|/)(test_|[Tt]est\.)[^/]*$|[._-]([Tt]ests?|[Ss]pecs?)\.[A-Za-z0-9]+$|(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$|/(tests?|__tests__|specs?|testlib|testing|ohostest)/|^(tests?|specs?)/|(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/"


@query(
    C.WITH
    + f""", {_DEPENDS}, c AS (SELECT path FROM f WHERE language = 'vue'),
    r(id, depth) AS (SELECT path, 0 FROM c UNION SELECT dep.a, r.depth + 1 FROM r JOIN dep ON dep.b = r.id WHERE r.depth < 5 AND NOT regexp_matches(r.id, '{_TEST}'))
    SELECT id AS file_path, min(depth) AS depth FROM r WHERE regexp_matches(id, '{_TEST}') GROUP BY id"""
)
def affected_tests(spark, d):
    """Tests that depend on any Vue file within five steps."""
    links = G.file_dependencies(C.nodes(spark, d, "id", "file_path"), C.edges(spark, d, "source", "target", "kind"))
    changed = C.files(spark, d).where("language = 'vue'").select(F.col("path").alias("file_path"))
    return G.affected_tests(links, changed)


@query()
def file_cycles(spark, d):
    """Files on dependency cycles with the component they belong to."""
    nodes, edges = C.nodes(spark, d, "id", "file_path"), C.edges(spark, d, "source", "target", "kind")
    links = G.file_dependencies(nodes, edges)
    return G.cycles(links.select(F.col("file_path").alias("src"), F.col("depends_on").alias("dst"))).withColumnRenamed("id", "file_path")


def _walk_sql(rounds: int, contains: bool = False) -> str:
    kinds = "" if contains else " AND kind <> 'contains'"
    steps = ["m0 AS (SELECT id, r AS m FROM s)"]
    for k in range(rounds):
        steps.append(
            f"""m{k + 1} AS MATERIALIZED (SELECT id, sum(m) AS m FROM (SELECT l.dst AS id, m.m * l.p * 0.75 AS m FROM m{k} m JOIN l ON m.id = l.src
            UNION ALL SELECT id, m * 0.75 FROM m{k} WHERE id NOT IN (SELECT src FROM l) UNION ALL SELECT id, r * 0.25 FROM s) GROUP BY id)"""
        )
    return (
        C.WITH
        + f""", b AS (SELECT source AS src, target AS dst FROM e WHERE source <> target{kinds} UNION ALL SELECT target, source FROM e WHERE source <> target{kinds}),
        w AS (SELECT src, dst, count(*) AS w FROM b GROUP BY src, dst), g AS (SELECT src, sum(w) AS deg FROM w GROUP BY src),
        l AS MATERIALIZED (SELECT w.src, w.dst, w.w / g.deg AS p FROM w JOIN g USING (src)),
        s AS MATERIALIZED (SELECT id, 1.0::DOUBLE / count(*) OVER () AS r FROM n WHERE kind = 'route'), {", ".join(steps)}
        SELECT id, round(m, 9) AS score FROM m{rounds}"""
    )


@query(_walk_sql(5))
def random_walk_5(spark, d):
    """Mass near the routes after five rounds of a walk with restart."""
    edges = C.edges(spark, d, "source", "target", "kind").where("kind <> 'contains'")
    scores = G.random_walk(edges, kind_ids(spark, d, "route"), None, 0.25, 5)
    return scores.select("id", F.round("score", 9).alias("score"))


@query(_walk_sql(25, True))
def random_walk_25(spark, d):
    """The full walk of 25 rounds from the routes over all kinds of use."""
    edges = C.edges(spark, d, "source", "target", "kind")
    return G.random_walk(edges, kind_ids(spark, d, "route")).select("id", F.round("score", 9).alias("score"))


@query()
def call_chains(spark, d):
    """Longest paths of use, of six hops at most, among types."""
    roots = C.nodes(spark, d, "id", "kind").where("kind in ('class', 'interface', 'enum', 'type_alias', 'component')").select("id")
    paths = G.chains(C.edges(spark, d, "source", "target", "kind"), roots, kinds=G.USES)
    return paths.select(F.concat_ws(" > ", "path").alias("path"), F.size("path").alias("n_nodes"))


@query(
    C.WITH
    + """SELECT name, count(*) AS n_definitions, count(DISTINCT file_path) AS n_files FROM n
    WHERE kind NOT IN ('file', 'import', 'parameter') GROUP BY name HAVING count(*) > 1"""
)
def homonyms(spark, d):
    """Names defined more than once."""
    types = C.nodes(spark, d, "name", "kind", "file_path").where("kind not in ('file', 'import', 'parameter')")
    return types.groupBy("name").agg(rows().alias("n_definitions"), F.countDistinct("file_path").alias("n_files")).where("n_definitions > 1")


@query(
    C.WITH
    + """SELECT t.id, t.name, count(DISTINCT e.source) AS n_implementers FROM e JOIN n t ON e.target = t.id WHERE e.kind IN ('extends', 'implements') GROUP BY t.id, t.name"""
)
def inheritance_survey(spark, d):
    """Supertypes with the number of their direct subtypes."""
    kin = C.edges(spark, d, "source", "target", "kind").where("kind in ('extends', 'implements')")
    named = kin.join(C.nodes(spark, d, "id", "name").withColumnRenamed("id", "t_id"), F.col("target") == F.col("t_id"))
    return named.groupBy(F.col("t_id").alias("id"), "name").agg(F.countDistinct("source").alias("n_implementers"))


@query(
    C.WITH
    + f"""SELECT t.file_path, count(DISTINCT e.source) AS n_callers, count(DISTINCT s.file_path) AS n_caller_files,
    count(DISTINCT CASE WHEN regexp_matches(s.file_path, '{_TEST}') THEN s.file_path END) AS n_test_files
    FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE e.kind <> 'contains' AND s.file_path <> t.file_path GROUP BY t.file_path"""
)
def blast_radius(spark, d):
    """Per file: callers from elsewhere, their files, and how many of these are tests."""
    at = C.nodes(spark, d, "id", "file_path")
    s = at.select(F.col("id").alias("s_id"), F.col("file_path").alias("s_path"))
    t = at.select(F.col("id").alias("t_id"), F.col("file_path").alias("file_path"))
    used = C.edges(spark, d, "source", "target", "kind").where("kind <> 'contains'")
    joined = used.join(s, F.col("source") == F.col("s_id")).join(t, F.col("target") == F.col("t_id")).where("s_path <> file_path")
    return joined.groupBy("file_path").agg(
        F.countDistinct("source").alias("n_callers"), F.countDistinct("s_path").alias("n_caller_files"),
        F.countDistinct(F.when(is_test_file(F.col("s_path")), F.col("s_path"))).alias("n_test_files"),
    )


@query(
    C.WITH
    + """SELECT id, 'ancestor' AS role, source AS other, kind FROM (SELECT target AS id, source, kind FROM e WHERE kind = 'contains')
    WHERE id IN (SELECT id FROM n WHERE kind = 'enum') UNION ALL
    SELECT source, 'child', target, kind FROM e WHERE kind = 'contains' AND source IN (SELECT id FROM n WHERE kind = 'enum') UNION ALL
    SELECT target, 'incoming', source, kind FROM e WHERE kind <> 'contains' AND target IN (SELECT id FROM n WHERE kind = 'enum') UNION ALL
    SELECT source, CASE WHEN kind IN ('type_of', 'returns') THEN 'type' ELSE 'outgoing' END, target, kind FROM e WHERE kind <> 'contains' AND source IN (SELECT id FROM n WHERE kind = 'enum')"""
)
def node_context(spark, d):
    """The surroundings of every enum: containers, members, references each way, types."""
    edges, ids = C.edges(spark, d, "source", "target", "kind"), kind_ids(spark, d, "enum").select(F.col("id").alias("k_id"))
    inside = edges.join(ids, F.col("target") == F.col("k_id"), "left_semi")
    outside = edges.join(ids, F.col("source") == F.col("k_id"), "left_semi")
    into = inside.select(F.col("target").alias("id"), F.when(F.col("kind") == "contains", "ancestor").otherwise("incoming").alias("role"), F.col("source").alias("other"), "kind")
    role = F.when(F.col("kind") == "contains", "child").when(F.col("kind").isin("type_of", "returns"), "type").otherwise("outgoing")
    return into.unionByName(outside.select(F.col("source").alias("id"), role.alias("role"), F.col("target").alias("other"), "kind"))


@query(C.WITH + "SELECT id, name, 'project' AS origin FROM n UNION ALL SELECT id, name, 'sdk' FROM sdk_nodes WHERE id NOT IN (SELECT id FROM n)")
def federated_nodes(spark, d):
    """Both graphs as one; the project's row wins on an id of both."""
    own = C.nodes(spark, d, "id", "name")
    other = C.sdk_nodes(spark, d).select("id", "name").join(own.select("id"), "id", "left_anti")
    return own.withColumn("origin", F.lit("project")).unionByName(other.withColumn("origin", F.lit("sdk")))


@query(r"""SELECT replace(path, '\', '/') AS path, CASE WHEN count(*) = 1 THEN 'stable' WHEN count(DISTINCT content_hash) = 1 THEN 'touched' ELSE 'changed' END AS state,
    count(*) AS n_rows FROM files GROUP BY 1""")
def file_history(spark, d):
    """Whether a file's stored states differ in content."""
    states = table(spark, d, "files").select(plain_path(F.col("path")).alias("path"), "content_hash")
    state = F.when(rows() == 1, "stable").when(F.countDistinct("content_hash") == 1, "touched").otherwise("changed")
    return states.groupBy("path").agg(state.alias("state"), rows().alias("n_rows"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at) AS up, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS down FROM files)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM (SELECT path, content_hash FROM files WHERE indexed_at < TIMESTAMPTZ '2024-01-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1) a
    FULL JOIN (SELECT path, content_hash FROM r WHERE down = 1) b ON a.path = b.path WHERE a.content_hash IS DISTINCT FROM b.content_hash OR a.path IS NULL OR b.path IS NULL""")
def hash_diff(spark, d):
    """Files added or modified since the start of 2024."""
    files = table(spark, d, "files").select("path", "indexed_at", "content_hash")
    before = S.newest(files.where(F.col("indexed_at") < F.timestamp_seconds(F.lit(1704067200))), "path", "indexed_at")
    return S.hash_diff(before, S.newest(files, "path", "indexed_at"))


@query(
    C.WITH
    + r""", a AS (SELECT DISTINCT replace(file_path, '\', '/') AS file_path, name FROM nodes WHERE updated_at < TIMESTAMPTZ '2024-01-01 00:00:00+00'),
    b AS (SELECT DISTINCT file_path, name FROM n)
    SELECT b.file_path, b.name, 'added' AS change FROM b ANTI JOIN a USING (file_path, name) UNION ALL
    SELECT a.file_path, a.name, 'removed' FROM a ANTI JOIN b USING (file_path, name)"""
)
def definition_delta(spark, d):
    """Definitions that appeared or went away since the start of 2024."""
    raw = table(spark, d, "nodes")
    old = raw.where(F.col("updated_at") < F.timestamp_seconds(F.lit(1704067200))).select(plain_path(F.col("file_path")).alias("file_path"), "name")
    return S.definition_delta(old, C.nodes(spark, d, "file_path", "name"))


@query("""WITH few AS (SELECT name_tail FROM unresolved_refs WHERE status = 'failed' GROUP BY name_tail HAVING count(*) <= 500)
    SELECT id, reference_name, name_tail FROM unresolved_refs WHERE status = 'failed' AND name_tail IN (SELECT name_tail FROM few) AND name_tail IN (SELECT name FROM nodes)""")
def failed_ref_retry(spark, d):
    refs = table(spark, d, "unresolved_refs").select("id", "reference_name", "name_tail", "status")
    return S.retry_failed(refs, table(spark, d, "nodes").select("name")).select("id", "reference_name", "name_tail")


@query(
    C.WITH
    + """, gone AS (SELECT id FROM n WHERE starts_with(file_path, 'vale-maps/'))
    SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM gone)) AS n_nodes,
    (SELECT count(*) FROM e WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)) AS n_edges,
    (SELECT count(*) FROM f WHERE NOT starts_with(path, 'vale-maps/')) AS n_files,
    (SELECT count(*) FROM unresolved_refs WHERE from_node_id NOT IN (SELECT id FROM gone)) AS n_refs"""
)
def cascade_delete(spark, d):
    """Sizes of the graph after deleting one repository with everything that hangs on it."""
    whole = S.Snapshot(C.nodes(spark, d, "id", "file_path"), C.edges(spark, d, "source", "target", "kind"), C.files(spark, d), table(spark, d, "unresolved_refs"))
    gone = whole.files.where(F.col("path").startswith("vale-maps/")).select("path")
    gone = gone.unionByName(whole.nodes.where(F.col("file_path").startswith("vale-maps/")).select(F.col("file_path").alias("path"))).distinct()
    less = whole.delete_files(gone)
    out = less.nodes.agg(rows().alias("n_nodes"))
    for name, df in (("n_edges", less.edges), ("n_files", less.files), ("n_refs", less.refs)):
        out = out.crossJoin(F.broadcast(df.agg(rows().alias(name))))
    return out


@query(C.WITH + "SELECT id, unnest(decorators) AS decorator FROM n")
def decorators(spark, d):
    return C.nodes(spark, d, "id", "decorators").select("id", F.explode("decorators").alias("decorator"))


@query(
    C.WITH
    + r"""SELECT regexp_extract(file_path, '^([^/]+)', 1) AS repository, kind, count(*) AS n, grouping(regexp_extract(file_path, '^([^/]+)', 1)) + grouping(kind) AS level
    FROM n GROUP BY ROLLUP (regexp_extract(file_path, '^([^/]+)', 1), kind)"""
)
def rollup_by_repository(spark, d):
    """Symbols per repository and kind with subtotals."""
    nodes = C.nodes(spark, d, "file_path", "kind").withColumn("repository", F.regexp_extract("file_path", r"^([^/]+)", 1))
    level = (F.grouping("repository") + F.grouping("kind")).cast("long")
    return nodes.rollup("repository", "kind").agg(rows().alias("n"), level.alias("level"))
