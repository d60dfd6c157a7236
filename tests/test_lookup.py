import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.operators import lookup as L
from graphloom.runtime import bounded


@pytest.mark.parametrize(
    "word, stems",
    [
        ("caching", {"cach", "cache"}), ("running", {"runn", "runne", "run"}), ("eviction", {"evict"}), ("management", {"manage"}), ("entries", {"entry"}), ("classes", {"class"}), ("errors", {"error"}), ("class", set()),
        ("carried", {"carrie", "carri", "carry"}), ("handler", {"handl", "handle"}), ("getter", {"gett", "gette", "get"}), ("need", set()), ("speed", set()), ("bus", set()), ("ring", set()), ("", set()),
    ],
)
def test_stems(spark, word, stems):
    df = spark.createDataFrame([(word,)], "w string")
    assert set(df.select(L.stem_variants(F.col("w"))).first()[0]) == stems


def test_question_terms_and_identifiers(spark):
    df = spark.createDataFrame([("How does getUserName reach render_cache and Store.load in the files?",), (None,), ("",)], "t string")
    got = [set(r[0] or []) for r in df.select(L.question_terms(F.col("t"), stems=False)).collect()]
    assert got[0] == {"getusername", "render_cache", "store.load", "get", "user", "name", "reach", "render", "cache", "store", "load"} and got[2] == set()
    tokens = spark.createDataFrame([("a_b",), ("x1",), ("setMail",), ("HTTP",), ("Screen",), ("flat",), ("",), (None,)], "t string")
    assert [r[0] for r in tokens.select(L.distinctive(F.col("t"))).collect()] == [True] * 4 + [False] * 4


def test_spec_search_has_three_stages(spark):
    specs = spark.createDataFrame([(1, "Cache", "about tables", 5), (2, "Cache tables", "x", 4), (3, "Other", "the cache of tables", 3), (4, None, "mycachething", 9)], "id long, title string, body string, ts_ms long")
    assert [(r["id"], r["score"], r["method"]) for r in L.search_specs(specs, "cache").collect()] == [(1, 3.0, "words"), (2, 2.5, "words"), (3, 1.0, "words"), (4, 0.5, "inside")]
    assert [(r["id"], r["method"]) for r in L.search_specs(specs, "zebra", 2).collect()] == [(4, "newest"), (1, "newest")]
    assert [r["id"] for r in L.search_specs(specs, "  ", 2).collect()] == [1, 2]


def test_rare_words_only_where_nothing_else_answers(spark):
    v = spark.createDataFrame([("parser", "parserLoad"), ("load", "parserLoad"), ("parser", "parserSave"), ("save", "parserSave"), ("alone", "aloneThing"), ("thing", "aloneThing")], "segment string, name string")
    asked = spark.createDataFrame([(1, "parsers"), (1, "alone"), (2, "parser"), (3, "load")], "query_id long, word string")
    none = spark.createDataFrame([(2,)], "query_id long")
    assert rows(L.rare_words(v, asked, none)) == [(1, "parsers", "parser", "parserLoad"), (1, "parsers", "parser", "parserSave")]


def test_rollup_groups_and_hidden_values(spark):
    files = spark.createDataFrame([("a/b/x.py", 2), ("a/y.py", 3), ("z.py", 5), (None, 1)], "path string, size long")
    assert rows(L.directory_rollup(files)) == [("a", 1, 2, 5), ("a/b", 2, 1, 2)]
    nodes = spark.createDataFrame([("constant", "yaml", "k = secret"), ("function", "go", "f()"), (None, None, "g()")], "kind string, language string, signature string")
    assert [r["signature"] for r in L.without_values(nodes).collect()] == [None, "f()", "g()"]
    routes = spark.createDataFrame([("route", "r.py")] * 3 + [("route", "q.py")] + [("route", "test/t.py")] * 9, "kind string, file_path string")
    assert rows(L.top_route_file(routes)) == [("r.py", 3, 4)] and L.top_route_file(routes, share=0.9).count() == 0


def test_probes_and_builtins(spark):
    nodes = spark.createDataFrame([("Store",), ("only",)], "name string")
    refs = spark.createDataFrame([(1, "store.load", "calls", "go"), (2, "fmt.Println", "calls", "go"), (3, "nothing", "calls", "go"), (4, "x/y", "imports", "go"), (5, "only", "calls", "python"), (6, "print", "calls", "python")], "ref_id long, reference_name string, reference_kind string, ref_language string")
    assert rows(L.answerable(refs, nodes).select("ref_id")) == [(1,), (4,), (5,)]
    assert rows(L.without_builtins(refs, L.default_builtins(spark)).select("ref_id")) == [(1,), (3,), (4,), (5,)]


def test_bounded_looks_at_rows_and_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 1000) AS t", "array(id) AS a")
    assert bounded(df) and not bounded(df, 9) and not bounded(df, most_bytes=9_000) and bounded(df.limit(0))
