import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import text as X


@pytest.mark.parametrize(
    "raw, text, kinds, languages, paths, names",
    [
        ("kind:function auth", "auth", ["function"], [], [], []),
        ("lang:go language:rust x", "x", [], ["go", "rust"], [], []),
        ('path:"src/a b" name:get', "", [], [], ["src/a b"], ["get"]),
        ("kind:nonsense foo", "kind:nonsense foo", [], [], [], []),
        ("TODO: fix", "TODO: fix", [], [], [], []),
        ("", "", [], [], [], []),
    ],
)
def test_parse_query(raw, text, kinds, languages, paths, names):
    q = X.parse_query(raw)
    assert (q.text, q.kinds, q.languages, q.paths, q.names) == (text, kinds, languages, paths, names)


@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6), st.integers(0, 3))
def test_bounded_distance(a, b, most):
    def plain(x, y):
        return len(x) + len(y) if not x or not y else min(plain(x[1:], y) + 1, plain(x, y[1:]) + 1, plain(x[1:], y[1:]) + (x[0] != y[0]))

    assert X.bounded_distance(a, b, most) == min(plain(a, b), most + 1)


def nodes(spark):
    data = [
        ("1", "function", "renderToken", "a::renderToken", "src/core/render.ts", "typescript", 3, "Draws a token.", "()"),
        ("2", "class", "Token", "a::Token", "src/core/token.ts", "typescript", 1, None, None),
        ("3", "method", "getTokn", "a::getTokn", "test/core/token_test.ts", "typescript", 9, "", ""),
        ("4", "function", "other", None, "lib/x.py", "python", 1, None, None),
    ]
    return spark.createDataFrame(data, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, docstring string, signature string")


def test_bm25_by_prefix(spark):
    got = {r["id"]: r["score"] for r in X.bm25(nodes(spark), ["tok"]).collect()}
    assert set(got) == {"1", "2"} and got["2"] > got["1"] > 0
    assert X.bm25(nodes(spark).where(F.lit(False)), ["tok"]).count() == 0


def test_tiers_and_fuzzy(spark):
    assert rows(X.like_tiers(nodes(spark), "Token").select("id", "score")) == [("1", 0.8), ("2", 1.0)]
    assert rows(X.fuzzy_names(nodes(spark), "tokem").select("id", "distance")) == [("2", 1)]
    assert rows(X.substring_lookup(nodes(spark), "token", True).select("id")) == [("1",)]


def test_search_falls_back_and_filters(spark):
    assert [r["id"] for r in X.search(nodes(spark), "Token", 10).collect()][0] == "2"
    assert rows(X.search(nodes(spark), "enderTok", 10).select("id")) == [("1",)]
    assert rows(X.search(nodes(spark), "gettoken", 10).select("id")) == [("3",)]
    assert rows(X.search(nodes(spark), "lang:python", 10).select("id")) == [("4",)]
    assert rows(X.search(nodes(spark), "token path:core/token", 10).select("id")) == [("2",)]
    sdk = spark.createDataFrame([("s", "class", "TokenKit", "sdk.TokenKit", "k.ts", "typescript")], "id string, kind string, name string, qualified_name string, file_path string, language string")
    assert "s" in [r["id"] for r in X.search(nodes(spark), "Token", 10, attached=sdk).collect()]


def test_bonuses(spark):
    df = nodes(spark)
    got = dict(rows(df.select("id", X.name_match_bonus(F.col("name"), "render token"))))
    assert got == {"1": 80, "2": 60, "3": 0, "4": 0}
    path = dict(rows(df.select("id", X.path_relevance(F.col("file_path"), "token"))))
    assert path == {"1": 0, "2": 13, "3": -2, "4": 0}


def test_segments_and_prose(spark):
    df = spark.createDataFrame([("HTMLParser2Fast_x9",), ("__123__",), ("",)], "name string")
    assert [r[0] for r in df.select(N.segments(F.col("name"))).collect()] == [["html", "parser2", "fast", "x9"], [], []]
    words = spark.createDataFrame([("The États ARE parsed 12345 parses",), (None,)], "t string").select(X.prose_words(F.col("t"))).collect()
    assert words[0][0] == ["etats", "parsed", "parses"] and words[1][0] is None
    v = spark.createDataFrame([("boxes",), ("branches",), ("users",), ("glass",)], "w string").select(X.word_variants(F.col("w"))).collect()
    assert [r[0] for r in v] == [["boxes"], ["branches", "branch", "branche"], ["users", "user"], ["glass"]]


def test_bm25_many_matches_single(spark):
    df = nodes(spark)
    post, lengths = X.postings(df, "id", X.WEIGHTS)
    asked = spark.createDataFrame([(1, "tok"), (2, "zzz")], "query_id long, term string")
    many = {r["id"]: round(r["score"], 9) for r in X.bm25_many(post, lengths, asked, 5).collect()}
    assert many == {r["id"]: round(r["score"], 9) for r in X.bm25(df, ["tok"]).collect()}


def test_paths(spark):
    df = spark.createDataFrame([("src/a/b/x.ts", "src/a/c/y.ts"), ("x.ts", "y.ts"), ("a/b/c/d/e/f/g/x", "a/b/c/d/e/f/g/y")], "a string, b string")
    assert [r[0] for r in df.select(N.shared_directories(F.col("a"), F.col("b"))).collect()] == [30, 15, 80]
    t = spark.createDataFrame([("a/test_x.py",), ("a/x.spec.ts",), ("a/FooTest.java",), ("a/latest.py",), ("contest/x.py",), ("tests/x.py",)], "p string")
    assert [r[0] for r in t.select(N.is_test_file(F.col("p"))).collect()] == [True, True, True, False, False, True]
    c = spark.createDataFrame([("中文ab字",)], "t string").select(N.cjk_spaced(F.col("t"))).first()[0]
    assert c == "中 文ab字"


def test_bm25_many_is_whole_in_parts(spark, monkeypatch):
    """Blocks, pieces and cuts of any size give what scoring every pair gives, and pairs are not shuffled."""
    from graphloom.operators import many

    words = "alpha beta gamma delta eps zeta eta theta".split()
    data = [(i, " ".join(words[(i * j) % 8] for j in range(1, 2 + i % 5))) for i in range(300)]
    df = spark.createDataFrame(data, "id long, text string")
    asked = spark.createDataFrame([(q, t) for q in range(6) for t in words[q % 4 : q % 4 + 1 + q // 2]], "query_id long, term string")
    post, lengths = X.postings(df, "id", {"text": 1.0})
    scores = {}
    for q in range(6):
        for r in X.bm25(df.select("id", "text"), words[q % 4 : q % 4 + 1 + q // 2], {"text": 1.0}).collect():
            scores.setdefault(q, []).append((-round(r["score"], 9), r["id"]))
    want = {(q, i, s) for q, found in scores.items() for s, i in sorted(found)[:7]}

    def got():
        return {(r["query_id"], r["id"], -round(r["score"], 9)) for r in X.bm25_many(post, lengths, asked, 7).collect()}

    assert got() == want
    for name, value in (("BLOCK_QUERIES", 2), ("HITS", 10), ("POOL", 5)):
        monkeypatch.setattr(many, name, value)
    assert got() == want
    plan = X.bm25_many(post, lengths, asked, 7)._jdf.queryExecution().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") > 0


def test_prefix_search_over_hot_names(spark):
    """Rows of one name tie: the least ids are kept, in however many batches and tasks they lie."""
    data = [(f"n{i:05d}", "getValue") for i in range(12_000)] + [("a0", "get"), ("a1", "getter"), ("z", "other")]
    df = spark.createDataFrame(data, "id string, name string").repartition(5)
    asked = spark.createDataFrame([(1, "get"), (2, "getv"), (3, "get"), (4, "none")], "query_id long, term string")
    best = X.bm25_many(*X.postings(df, "id", {"name": 1.0}), asked, 4)
    assert "(term" not in best._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in best.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {1: ["a0", "a1", "n00000", "n00001"], 2: ["n00000", "n00001", "n00002", "n00003"], 3: ["a0", "a1", "n00000", "n00001"]}


def test_segment_matches_in_parts(spark, monkeypatch):
    """Pairs of names and queries are those of a plain count, in blocks and pieces of any size, and are not shuffled."""
    from graphloom.operators import many

    words = ["boxes", "tokens", "class", "alpha", "gamma", "boss", "cache", "caches"]
    names = [(s, f"n{i}") for i in range(60) for s in {words[(i * j) % 7] for j in range(1, 4)} | {"boxe", "token"}]
    asked = [(q, w) for q in range(9) for w in words[q % 5 : q % 5 + 1 + q // 2]]
    vocabulary, queries = spark.createDataFrame(names, "segment string, name string"), spark.createDataFrame(asked, "query_id long, word string")
    variants = {w: set(v) for w, v in queries.select("word", X.word_variants(F.col("word"))).collect()}
    held = {}
    for s, n in names:
        held.setdefault(n, set()).add(s)
    counts = {(q, n): sum(1 for p, w in set(asked) if p == q and variants[w] & segs) for q in range(9) for n, segs in held.items()}
    want = sorted((q, n, c) for (q, n), c in counts.items() if c >= 2)
    assert rows(X.segment_matches(vocabulary, queries)) == sorted(want, key=repr) and want
    for name, value in (("BLOCK_QUERIES", 2), ("HITS", 7)):
        monkeypatch.setattr(many, name, value)
    found = X.segment_matches(vocabulary, queries)
    assert rows(found) == sorted(want, key=repr)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
