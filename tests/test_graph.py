from collections import defaultdict, deque

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import graph as G

EDGE = "id long, source string, target string, kind string, line int, col int"
LINKS = st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), min_size=1, max_size=14)
FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def edges(spark, links, kind="calls"):
    return spark.createDataFrame([(i, a, b, kind, None, None) for i, (a, b) in enumerate(links)], EDGE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def plain_bfs(links, root, depth):
    out, queue = {root: 0}, deque([root])
    nxt = defaultdict(set)
    for a, b in links:
        nxt[a].add(b)
    while queue:
        v = queue.popleft()
        if out[v] < depth:
            for u in nxt[v] - out.keys():
                out[u] = out[v] + 1
                queue.append(u)
    return out


@FEW
@given(LINKS)
def test_reach_is_breadth_first(spark, links):
    got = {r["id"]: r["depth"] for r in G.reach(G.adjacency(edges(spark, links)), G.roots_of(ids(spark, "a")), 2).collect()}
    assert got == plain_bfs(links, "a", 2)


@FEW
@given(LINKS)
def test_shortest_paths(spark, links):
    pairs = spark.createDataFrame([("a", t) for t in "abcdef"], "source string, target string")
    got = {r["target"]: r["hops"] for r in G.shortest_paths(edges(spark, links), pairs).collect()}
    assert got == plain_bfs(links, "a", 99)


@FEW
@given(LINKS)
def test_cycles_are_strong_components(spark, links):
    df = spark.createDataFrame(links, "src string, dst string")
    got = {r["id"]: r["component"] for r in G.cycles(df).collect()}
    reach = {v: plain_bfs(links, v, 99).keys() for v in "abcdef"}
    want = {}
    for v in "abcdef":
        same = [u for u in "abcdef" if u in reach[v] and v in reach[u]]
        if len(same) > 1:
            want[v] = min(same)
    assert got == want


def test_caps_keep_the_oldest_callers(spark):
    df = edges(spark, [(f"s{i}", "hub") for i in range(20)])
    assert rows(G.capped_incoming(df, 3).select("id")) == [(0,), (1,), (2,)]
    assert G.callers(df, ids(spark, "hub"), 1, cap=3).count() == 3


def test_impact_passes_through_containers_for_free(spark):
    nodes = spark.createDataFrame([("c", "class"), ("m", "method"), ("u", "function"), ("v", "function")], "id string, kind string")
    e = edges(spark, [("c", "m")], "contains").unionByName(edges(spark, [("u", "m"), ("v", "u")]))
    got = {r["id"]: r["depth"] for r in G.impact(e, nodes, ids(spark, "c"), 1).collect()}
    assert got == {"c": 0, "m": 0, "u": 1}
    assert G.impact(e, nodes, ids(spark, "c"), 2).count() == 4


def test_hierarchy_both_ways_and_dead_code(spark):
    e = edges(spark, [("b", "a"), ("c", "b")], "extends")
    assert rows(G.type_hierarchy(e, ids(spark, "b")).select("id", "relation")) == [("a", "ancestor"), ("c", "descendant")]
    nodes = spark.createDataFrame([("a", "class", False), ("b", "class", True), ("c", "class", None)], "id string, kind string, is_exported boolean")
    assert rows(G.dead_code(nodes, e).select("id")) == [("c",)]


def test_walk_keeps_mass(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")])
    scores = {r["id"]: r["score"] for r in G.random_walk(e, ids(spark, "a", "lonely"), rounds=6).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-9 and scores["lonely"] == 0.5 and scores["b"] > scores["c"]


def test_affected_tests_stop_at_tests(spark):
    dep = spark.createDataFrame([("test/a_test.py", "x.py"), ("test/b_test.py", "test/a_test.py"), ("y.py", "x.py"), ("test/c_test.py", "y.py")], "file_path string, depends_on string")
    got = rows(G.affected_tests(dep, spark.createDataFrame([("x.py",)], "file_path string")))
    assert got == [("test/a_test.py", 1), ("test/c_test.py", 2)]


def test_chains_keep_the_longest(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert [r[0] for r in G.chains(e, ids(spark, "a", "c", "d"), hops=4).collect()] == [["a", "b", "c", "d"]]


def test_globs(spark):
    files = spark.createDataFrame([("src/a/x.py",), ("src/a/b/x.py",), ("lib/x.py",)], "path string")
    assert G.file_glob(files, "src/*/x.py").count() == 1 and G.file_glob(files, "src/**/x.py").count() == 2
    nodes = spark.createDataFrame([("A::getMap",), ("A::get",), (None,)], "qualified_name string")
    assert G.qualified_glob(nodes, "*::get*").count() == 2 and G.qualified_glob(nodes, "A::get").count() == 1


def test_module_structure_and_dominant_file(spark):
    nodes = spark.createDataFrame([("a", "d/x.py"), ("b", "d/x.py"), ("c", "y.py"), ("e", None)], "id string, file_path string")
    assert rows(G.module_structure(nodes)) == [(".", 1, 1), ("d", 1, 2)]
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "c")])
    assert rows(G.dominant_file(nodes, e, 2)) == [("d/x.py", 2, 1)] and G.dominant_file(nodes, e, 3).count() == 0


def test_empty_graph(spark):
    none = edges(spark, [("a", "b")]).where(F.lit(False))
    assert G.reach(G.adjacency(none), G.roots_of(ids(spark, "a")), 3).count() == 1
    assert G.cycles(none.select(F.col("source").alias("src"), F.col("target").alias("dst"))).count() == 0
    assert rows(G.random_walk(none, ids(spark, "a"), rounds=2)) == [("a", 1.0)]


def test_file_cycles_close_over_calls_and_imports(spark, monkeypatch):
    from graphloom import graph_queries as Q

    nodes = spark.createDataFrame([("a", "a.py"), ("b", "b.py"), ("c", "c.py")], "id string, file_path string")
    links = edges(spark, [("a", "b")]).unionByName(edges(spark, [("b", "a")], "imports")).unionByName(edges(spark, [("b", "c"), ("c", "b")], "contains"))
    monkeypatch.setattr(Q.C, "nodes", lambda *_: nodes)
    monkeypatch.setattr(Q.C, "edges", lambda *_: links)
    assert rows(Q.file_cycles(spark, "").select("file_path", "component")) == [("a.py", "a.py"), ("b.py", "a.py")]


def test_shortest_paths_in_memory_and_in_joins(spark, monkeypatch):
    """The same least paths either way, with loops, double links, unknown ends and a depth; hops alone need no path."""
    from graphloom.operators import compact

    links = [("a", "c"), ("a", "b"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "e"), ("x", "y"), ("c", "f"), ("b", "f")]
    pairs = spark.createDataFrame([("a", "e"), ("a", "zz"), ("x", "y"), ("q", "q"), ("y", "x")], "source string, target string")
    df, some, every = edges(spark, links), ids(spark, "a", "x", "q"), ids(spark, *"abcdefxyqz")

    def found():
        many = [rows(G.shortest_paths(df, sources=some, targets=every, max_depth=most).select("source", "target", "path", "hops")) for most in (None, 2, 0)]
        return [*many, rows(G.shortest_paths(df, pairs).select("source", "target", "path", "hops")), rows(G.shortest_paths(df, sources=some, targets=every, paths=False).select("source", "target", "hops"))]

    here = found()
    assert ("a", "e", ["a", "b", "d", "e"], 3) in here[0] and ("a", "f", ["a", "b", "f"], 2) in here[1]
    assert here[3] == [("a", "e", ["a", "b", "d", "e"], 3), ("q", "q", ["q"], 0), ("x", "y", ["x", "y"], 1)]
    monkeypatch.setattr(compact, "LINKS", -1)
    assert found() == here


def test_shortest_paths_of_a_stored_table(spark, monkeypatch):
    """Hops between known ids only, to some of the nodes, the same in slices, in blocks of pairs and in joins."""
    from graphloom.operators import compact

    links = [(f"n{k:02}", f"n{(k * 7 + j) % 60:02}") for k in range(60) for j in (1, 5) if k % 9] + [("n01", "gone"), ("gone", "n09"), ("lost", "n02"), (None, "n03")]
    df, some, every, known = edges(spark, links), ids(spark, "n01", "n09", "n17", "alone"), [f"n{k:02}" for k in range(0, 60, 2)], ids(spark, *[f"n{k:02}" for k in range(60)], "alone", "n01")

    def found():
        return rows(G.shortest_paths(df, sources=some, targets=ids(spark, *every, "gone", "alone"), paths=False, known=known).select("source", "target", "hops"))

    sound = [(a, b) for a, b in links if None not in (a, b) and not {"gone", "lost"} & {a, b}]
    want = sorted((r, t, h) for r in ("n01", "n09", "n17", "alone") for t, h in plain_bfs(sound, r, 99).items() if t in [*every, "alone"])
    assert found() == want
    monkeypatch.setattr(compact, "SLICE", 7)
    monkeypatch.setattr(compact, "HELD", 40)
    monkeypatch.setattr(compact, "ROW", 11)
    assert found() == want
    monkeypatch.setattr(compact, "LINKS", -1)
    assert found() == want
