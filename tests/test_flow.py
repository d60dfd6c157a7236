import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import intervals as I
from graphloom.operators import mining as M
from graphloom.operators import resolve as R
from graphloom.operators.spec import SpecGraph

RANGES = st.lists(st.tuples(st.integers(1, 600), st.integers(0, 300)).map(lambda x: (x[0], x[0] + x[1])), max_size=8)
FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ranges(spark, pairs, key="f"):
    return spark.createDataFrame([(key, a, b) for a, b in pairs], "k string, start_line int, end_line int")


def lines(pairs):
    return {x for a, b in pairs for x in range(a, b + 1)}


@FEW
@given(RANGES, RANGES)
def test_merge_and_subtract_by_lines(spark, a, b):
    ma, mb = I.merge_ranges(ranges(spark, a), "k"), I.merge_ranges(ranges(spark, b), "k")
    got = [(r[1], r[2]) for r in rows(ma)]
    assert lines(got) >= lines(a) and all(y[0] > x[1] + 1 for x, y in zip(sorted(got), sorted(got)[1:]))
    left = [(r[1], r[2]) for r in rows(I.subtract_ranges(ma, mb, "k"))]
    assert lines(left) == lines(got) - lines([(r[1], r[2]) for r in rows(mb)])


@FEW
@given(RANGES, RANGES)
def test_overlap_join_equals_brute_force(spark, a, b):
    spans = spark.createDataFrame([(i, "f", *x) for i, x in enumerate(a)], "id int, file_path string, start_line int, end_line int")
    rs = spark.createDataFrame([(i, "f", *x) for i, x in enumerate(b)], "rid int, path string, r_start int, r_end int")
    got = sorted((r["id"], r["rid"]) for r in I.overlap_join(spans, rs, "file_path", "path", 64).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] <= y[1] and y[0] <= x[1])


def test_parse_diff():
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def f\n@@ -9 +9 @@\n@@ -20,3 +19,0 @@\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert I.parse_diff(diff) == [("x.py", 3, 6), ("x.py", 9, 9)]
    assert I.parse_diff("@@ -1 +2,2 @@\n") == [] and I.parse_diff("@@ -1 +2,2 @@\n", "p") == [("p", 2, 3)]


def test_scope_and_nearest(spark):
    nodes = spark.createDataFrame([("o", "class", "A", "f", 1, 50), ("i", "method", "m", "f", 5, 9), ("j", "method", "m", "f", 30, 35)], "id string, kind string, name string, file_path string, start_line int, end_line int")
    pts = spark.createDataFrame([(1, "f", 6), (2, "f", 20), (3, "f", 99), (4, "g", 1)], "point_id int, path string, line int")
    assert rows(I.enclosing_scope(nodes, pts).select("point_id", "scope_id")) == [(1, "i"), (2, "o"), (3, None), (4, None)]
    near = spark.createDataFrame([(1, "f", "m", 28)], "point_id int, path string, name string, line int")
    assert rows(I.nearest_symbol(nodes, near)) == [(1, "j")]


NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean"
REFS = "ref_id long, from_node_id string, reference_name string, reference_kind string, ref_line int, ref_col int, ref_path string, ref_language string, status string, tail string"


def ref(i, name, kind="calls", path="src/a/x.ts", language="typescript"):
    return (i, "n0", name, kind, 1, 1, path, language, "pending", name.replace("->", ".").replace("::", ".").split(".")[-1])


def test_resolution_strategies(spark):
    nodes = spark.createDataFrame(
        [
            ("n0", "function", "main", "src/a/x.ts::main", "src/a/x.ts", "typescript", 1, True),
            ("n1", "function", "only", "src/a/y.ts::only", "src/a/y.ts", "typescript", 1, True),
            ("n2", "function", "dup", "src/a/y.ts::dup", "src/a/y.ts", "typescript", 5, False),
            ("n3", "function", "dup", "far/z.ts::dup", "far/z.ts", "typescript", 5, True),
            ("n4", "method", "save", "src/a/y.ts::Store::save", "src/a/y.ts", "typescript", 9, False),
            ("n5", "class", "Store", "src/a/y.ts::Store", "src/a/y.ts", "typescript", 8, False),
            ("n6", "function", "gofn", "m.gofn", "m.go", "go", 1, True),
            ("n7", "file", "y.ts", "src/a/y.ts", "src/a/y.ts", "typescript", 1, False),
            ("n8", "interface", "Shape", "src/a/y.ts::Shape", "src/a/y.ts", "typescript", 20, True),
        ],
        NODES,
    )
    refs = spark.createDataFrame(
        [ref(1, "only"), ref(2, "dup"), ref(3, "gofn"), ref(4, "store.save"), ref(5, "ONLY"), ref(6, "a/y.ts", "imports"), ref(7, "gofn", "references"), ref(8, "Store::save"), ref(9, "Shape", "extends"), ref(10, "Store")],
        REFS,
    )
    exact = {r["ref_id"]: (r["target"], r["confidence"]) for r in R.by_exact_name(refs, nodes).collect()}
    assert exact[1] == ("n1", 0.9) and exact[2] == ("n2", 0.7) and exact[3] == ("n6", 0.5) and 7 not in exact
    best = {r["ref_id"]: (r["target"], r["confidence"], r["resolved_by"]) for r in R.resolve(refs, nodes).collect()}
    assert best[4] == ("n4", 0.85, "member") and best[5] == ("n1", 0.5, "fuzzy") and best[6] == ("n7", 0.85, "file-path") and best[8][0] == "n4"
    edges = {r["id"]: r["kind"] for r in R.edges_from(refs, R.resolve(refs, nodes), nodes).collect()}
    assert edges[9] == "implements" and edges[10] == "instantiates" and edges[1] == "calls"
    assert R.by_exact_name(refs, nodes, ceiling=1).where("ref_id = 2").count() == 0


def test_inherited_members(spark):
    nodes = spark.createDataFrame([("m", "method", "run", "A::run", "a", "ts", 1, False), ("b", "method", "stop", "B::stop", "b", "ts", 1, False)], NODES)
    edges = spark.createDataFrame([("A", "m", "contains"), ("B", "b", "contains"), ("A", "B", "extends")], "source string, target string, kind string")
    refs = spark.createDataFrame([(1, "m", "this.stop", "calls", 1, 1, "a", "ts", "pending", "stop")], REFS)
    none = spark.createDataFrame([], "ref_id long, target string, confidence double, resolved_by string")
    assert [r["target"] for r in R.inherited_members(refs, none, nodes, edges).collect()] == ["b"]


def test_commit_features(spark):
    df = spark.createDataFrame([("feat(Core): x PROJ-12 #3 #3",), ("chore: y",), ("Revert z",), ("plain text",), (None,)], "m string")
    assert [r[0] for r in df.select(M.ticket_refs(F.col("m"))).collect()][0] == ["PROJ-12", "#3"]
    assert [r[0] for r in df.select(M.scope_of(F.col("m"))).collect()][:2] == ["core", ""]
    assert [r[0] for r in df.select(M.design_relevant(F.col("m"))).collect()][:4] == [True, False, False, True]


def test_tf_idf_and_pairs(spark):
    data = [(1, "alpha beta", 0, ["s"], ["d/a.py"], []), (2, "alpha beta", 0, ["s"], ["d/a.py"], []), (3, "gamma delta", 10**12, ["t"], [], ["#1"]), (4, "", 0, [], [], ["#1"])]
    c = spark.createDataFrame(data, "id long, message string, ts_ms long, symbols array<string>, files array<string>, tickets array<string>")
    w = {(r["id"], r["term"]): r["weight"] for r in M.tf_idf(c, "id", "message").collect()}
    import math

    assert abs(w[1, "alpha"] - 0.5 * (math.log(5 / 3) + 1)) < 1e-12
    got = rows(M.commit_pairs(c).select("a", "b", F.round("score", 6)))
    assert got == [(1, 2, 0.72)]
    with pytest.raises(ValueError):
        M.commit_pairs(c, 0.2)


def test_pairs_alike_by_words_or_place_only(spark):
    data = [(1, "alpha beta", 0, ["p", "q"], [], []), (2, "alpha beta", 0, ["r", "s"], [], []), (3, "gamma delta", 10**12, list("abcd"), ["d/a.py"], []), (4, "gamma epsilon", 10**12, list("efgh"), ["d/a.py"], [])]
    c = spark.createDataFrame(data, "id long, message string, ts_ms long, symbols array<string>, files array<string>, tickets array<string>")
    assert [r[:2] for r in rows(M.commit_pairs(c))] == [(1, 2), (3, 4)]
    many = [(k, f"w{k % 7} w{k % 5} w{k % 3} common", k % 4 * 10**7, [f"s{k}", f"z{k}"], [f"d/f{k % 11}.py"] if k % 2 else [], []) for k in range(60)]
    c = spark.createDataFrame(many, c.schema)
    ids = c.select("id")
    every = ids.select(F.col("id").alias("a")).crossJoin(ids.select(F.col("id").alias("b"))).where("a < b")
    cosine = {(r["a"], r["b"]): r["cosine"] for r in M.cosine_of_pairs(M.tf_idf(c, "id", "message"), every).collect()}
    import math

    want = []
    for (a, b), cos in cosine.items():
        x, y = many[a], many[b]
        raw = 0.15 * (x[4] == y[4] != []) + 0.25 * cos + 0.1 * math.exp(-abs(x[2] - y[2]) / M.TIME_SCALE_MS)
        if raw >= 0.25:
            want.append((a, b))
    assert want and sorted(r[:2] for r in rows(M.commit_pairs(c))) == sorted(want)


def test_communities(spark):
    def clique(vs):
        return [(a, b, 1.0) for i, a in enumerate(vs) for b in vs[i + 1 :]]

    pairs = clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5, 0.1)] + clique([20, 21])
    df = spark.createDataFrame(pairs, "a long, b long, score double")
    got = {r["id"]: r["community"] for r in M.communities(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5, 20: 20, 21: 20}
    assert M.modularity(pairs, got) > M.modularity(pairs, dict.fromkeys(got, 0))
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)], "a long, b long, score double")
    assert {r["component"] for r in M.components(chain).collect()} == {0}


def test_large_components_keep_weakly_linked_members(spark):
    clique = [(a, b, 0.95) for a in range(205) for b in range(a + 1, 205)]
    df = spark.createDataFrame(clique + [(204, 300, 0.3), (300, 301, 0.3)], "a long, b long, score double")
    got = {r["id"]: r["community"] for r in M.communities(df).collect()}
    assert got.keys() == {*range(205), 300, 301} and {got[v] for v in range(205)} == {0}


def graph(spark):
    return SpecGraph(
        spark.createDataFrame([("s1", "Cache spec", "active", 1, "s1.md", 10), ("s2", "Old", "deprecated", 1, "s2.md", 5)], "id string, title string, status string, version int, file_path string, ts_ms long"),
        spark.createDataFrame([("c1", "fix cache", 3), ("c2", "more", 4)], "hash string, message string, ts_ms long"),
        spark.createDataFrame([("f1", "ADD", "src/a.py", 1, 10), ("f2", "ADD", "lib/src/a.py", 5, 6)], "id string, change_type string, file_path string, start_line int, end_line int"),
        spark.createDataFrame([("s1", "c1", "SUMMARIZED_FROM"), ("s1", "c2", "GENERATE"), ("s2", "c1", "GENERATE")], "spec_id string, commit_hash string, relation_type string"),
        spark.createDataFrame([("c1", "f1"), ("c2", "f2")], "commit_hash string, fragment_id string"),
        spark.createDataFrame([], "spec_id string, other_id string, relation_type string"),
    )


def test_spec_graph(spark):
    g = graph(spark)
    c = g.candidates("src/a.py", 5, 8).first()
    assert (c["n_fragments"], c["n_commits"], c["path_level"], c["overlap_lines"]) == (2, 2, 3, 4)
    assert abs(g.trace("src/a.py", 5, 8, "cache", 10).first()["score"] - 1.0) < 1e-9
    assert [r["commit_hash"] for r in g.context().where("spec_id = 's1'").orderBy("rank").collect()] == ["c2", "c1"]
    assert rows(g.affected_by(spark.createDataFrame([("x/lib/src/a.py",)], "path string"))) == [("s1",)]
    new = g.new_version(spark.createDataFrame([("s1",)], "id string"))
    assert rows(new.specs.select("id", "status", "version")) == [("s1", "deprecated", 1), ("s1@2", "active", 2), ("s2", "deprecated", 1)]
    assert new.spec_commit.where("spec_id = 's1@2'").count() == 2 and new.spec_spec.count() == 1
    with pytest.raises(ValueError):
        g.specs_of_file("")
    assert g.specs_of_file("a.py", 0)[1] is True


def _two_cliques(n=6):
    pairs = [(f"{side}{i}", f"{side}{j}", 1.0) for side in "xy" for i in range(n) for j in range(i + 1, n)]
    return pairs + [("x0", "y0", 0.1)]


@pytest.mark.parametrize("in_task", [10_000, 1])
def test_communities_in_a_task_and_by_rounds(spark, in_task):
    pairs = _two_cliques() + [("p", "q", 0.5)]
    got = {r["id"]: r["community"] for r in M.communities(spark.createDataFrame(pairs, "a string, b string, score double"), in_task=in_task).collect()}
    assert got == {**{f"x{i}": "x0" for i in range(6)}, **{f"y{i}": "y0" for i in range(6)}, "p": "p", "q": "p"}


def test_commit_pairs_lose_none(spark):
    import random

    r = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    data = []
    for i in range(40):
        data.append((i, " ".join(r.choices(words, k=4)), r.choice([0, 10**6, 5 * 10**8, 10**11]), [f"s{r.randint(0, 30)}"], [f"d{r.randint(0, 9)}/f{r.randint(0, 5)}.py"][: r.randint(0, 1)], []))
    c = spark.createDataFrame(data, "id long, message string, ts_ms long, symbols array<string>, files array<string>, tickets array<string>")
    got = {(x["a"], x["b"]): x["score"] for x in M.commit_pairs(c).collect()}
    w: dict = {}
    for x in M.tf_idf(c, "id", "message").collect():
        w.setdefault(x["id"], {})[x["term"]] = x["weight"]

    def jac(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0

    import math

    want = {}
    for a in data:
        for b in data:
            if a[0] < b[0]:
                norm = [math.sqrt(sum(v * v for v in w[k[0]].values())) for k in (a, b)]
                cos = sum(v * w[b[0]].get(t, 0) for t, v in w[a[0]].items()) / (norm[0] * norm[1])
                dirs = [["/".join(f.split("/")[:2]) for f in k[4]] for k in (a, b)]
                raw = 0.4 * jac(a[3], b[3]) + 0.15 * max(jac(a[4], b[4]), jac(*dirs)) + 0.25 * cos + 0.1 * math.exp(-abs(a[2] - b[2]) / M.TIME_SCALE_MS)
                score = raw * (0.6 + 0.4 * min(min(len(k[3]) / max(len(k[4]), 1) for k in (a, b)) / 2, 1))
                if score >= 0.25:
                    want[a[0], b[0]] = score
    assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_qualified_suffixes(spark):
    """Any end of a qualified name answers, of whatever length; own file first, then the first file, unknown files last."""
    nodes = spark.createDataFrame(
        [
            ("a", "method", "get", "m.fox.get", None, "go", 1, False),
            ("b", "method", "get", "m.fox.get", "k/b.go", "go", 9, False),
            ("c", "method", "get", "m.box.get", "k/a.go", "go", 2, False),
            ("d", "method", "get", "get", "k/0.go", "go", 2, False),
            ("e", "method", "get", "q::fox::get", "k/c.go", "go", 2, False),
        ],
        NODES,
    )
    names = ["fox.get", "x.get", "ox.get", ".get", "fox::get", "cat.get", "m.box.get"]
    refs = spark.createDataFrame([ref(i, n, path="p/x.go", language="go") for i, n in enumerate(names)] + [ref(9, "ox.get", path="k/b.go", language="go")], REFS)
    got = {r["ref_id"]: (r["target"], r["confidence"]) for r in R.by_qualified_name(refs, nodes).collect()}
    assert got == {0: ("b", 0.85), 1: ("c", 0.85), 2: ("c", 0.85), 3: ("c", 0.85), 4: ("e", 0.85), 6: ("c", 0.95), 9: ("b", 0.85)}


def test_references_to_names_of_many_symbols(spark, monkeypatch):
    """However many symbols have a name, its references get the best of them; folder by folder the same as one by one."""
    kinds, languages, folders = ["function", "class", "interface", "field"], ["typescript", "go", "tsx", "python"], ["", "src/", "src/a/", "src/a/b/", "src/a/b/c/d/e/f/g/", "src/b/", "far/a/", "/src/a/"]
    nodes = [(f"n{i:03}", kinds[i * 7 % 4], "get", None, f"{folders[i * 5 % 8]}f{i % 3}.x", languages[i // 3 % 3], i % 50, [True, False, None][i % 3]) for i in range(600)]
    refs = [
        (k, "n0", "get", kind, 10 * k, 1, path, language, "pending", "get")
        for k, (kind, path, language) in enumerate(
            (kind, path, language)
            for kind in ("calls", "references", "instantiates", "decorates", "imports")
            for path in ("src/a/f1.x", "src/a/b/c/d/e/f/g/f0.x", "src/a/b/c/d/e/f/h/f0.x", "src/a/b/new.x", "f2.x", "other/f1.x", "/src/a/f1.x")
            for language in languages
        )
    ]
    nodes, refs = spark.createDataFrame(nodes, NODES), spark.createDataFrame(refs, REFS)
    many = rows(R.by_exact_name(refs, nodes))
    assert len({r[0] for r in many}) == len(many) >= 126
    monkeypatch.setattr(R, "DIRECT", 10_000)
    assert rows(R.by_exact_name(refs, nodes)) == many
    monkeypatch.undo()
    monkeypatch.setattr(R, "DIRECT", 0)
    assert rows(R.by_exact_name(refs, nodes)) == many
