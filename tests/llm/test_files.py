import json
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import handwritten as H
from graphloom.llm import parsing as P
from graphloom.llm import repair as R


def err(*entries):
    return json.dumps([dict(zip(("message", "severity", "code"), e)) for e in entries])


BROKEN = [
    err(("unexpected token ')' at line 3", "error")), err(("bracket ( has no partner",)), err(("x", "warning"), ("语法错误：文件在第 9 行处意外结束", "ERROR")), json.dumps({"msg": "input ran out inside a declaration"}),
    json.dumps(json.dumps([{"message": "SyntaxError near \"x\"", "severity": "error"}])), "fatal: unbalanced indentation at the last line", '[{"message": "string literal still open on line 2", "severity": "error"}, {"mess',
    err(("ERROR node spans lines 1-2, tree incomplete", "error")), err(("leftover conflict marker on line 2: parse error", None)), "invalid statement: 'worker died'",
]
SOUND = [
    None, "", "null", "[]", "{}", "[", "[1, null]", err(("unexpected token 'x'", "warning")), err(("Parse worker died: heap limit reached", "error", "parse_error")), err(("Import 'x' not found", "error")),
    err(("Syntax colouring plugin crashed after 3 tokens", "error")), err(("Symbol a declared twice on line 3", "error")), err(("type check: a has no member 'b'", "error")), err(("No grammar installed for this file kind", "error")),
    err(("recovered after unexpected token ';', tree complete", "error")), "warning: unexpected token 'x'", err(("File could not be read: permission refused", "error")), "[" * 5000,
]


@pytest.mark.parametrize("errors", BROKEN)
def test_broken(errors):
    assert P.breaks_grammar(errors)


@pytest.mark.parametrize("errors", SOUND)
def test_sound(errors):
    assert not P.breaks_grammar(errors)


@given(st.text(max_size=60))
def test_entries_never_crash(text):
    list(P.entries(text))


@pytest.mark.parametrize(
    "language, path, foreign",
    [
        ("python", "a/b.py", False), ("PY", "a\\b.PY", False), ("rust", "a/b.py", True), ("arkts", "x.ts", False), ("cpp", "x.h", False), ("objc", "x.h", False), ("go", "x.h", True), ("unknown", "x.py", False), (None, "x.py", False),
        ("python", "x.txt", False), ("python", None, False), ("c#", "x.cs", False), ("javascript", "x.tsx", False), ("java", "x.kt", True), ("klingon", "x.py", False), ("python", ".py", False),
    ],
)
def test_contradiction(language, path, foreign):
    assert P.contradicts(language, path) is foreign


TEXTS = {
    "python": "def f(x):\n    return [x, '(']\n", "web": "import { a } from 'b';\nexport const f = (x) => { return `${x}{`; };\n", "go": "package main\nfunc f(x int) int {\n\treturn x // }\n}\n",
    "c": "#include <a.h>\nint main(void) { char c = '}'; return 0; }\n", "java": "package a.b;\npublic class C { void f() { String s = \"{\"; } }\n", "rust": "use a::b;\npub fn f(x: &'static str) -> u8 { 1 }\n",
    "csharp": "using System;\nnamespace A { public class B { public int C { get; set; } } }\n", "kotlin": "package a\nfun f(x: Int): Int { val y = \"${'$'}{x}\"; return x }\n", "json": '{"a": [1]}',
}


@pytest.mark.parametrize("family", TEXTS)
def test_texts_parse_in_their_own_grammar(family):
    assert P.diagnose(TEXTS[family], family) == (True, None)


@pytest.mark.parametrize("family, other", [("python", "go"), ("web", "python"), ("java", "python"), ("rust", "python"), ("go", "python")])
def test_foreign_texts_name_their_grammar(family, other):
    ok, foreign = P.diagnose(TEXTS[family], other)
    assert not ok and foreign == family


@pytest.mark.parametrize("family", [f for f in TEXTS if f not in ("json",)])
def test_truncation_and_conflicts_fit_no_grammar(family):
    text = TEXTS[family]
    cut = text[: max(text.rfind("}"), text.rfind("]"))]
    conflict = text + "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n"
    assert P.diagnose(cut, family) == (False, None) and P.diagnose(conflict, family) == (False, None)
    assert P.diagnose(None, family) == (True, None) == P.diagnose("  \n", family)


def test_unparsed_files(spark):
    data = [("r/a.py", "python", BROKEN[0]), ("r/a.py", "python", BROKEN[0]), ("w\\b.go", "java", None), ("r/c.go", "go", "[]"), (None, "go", BROKEN[0]), ("d.py", None, "x" * 100_000)]
    df = spark.createDataFrame(data, "path string, language string, errors string").selectExpr("*", "1 AS broken", "2 AS repository")
    got = sorted(tuple(r) for r in P.unparsed_files(df).collect())
    assert got == [("d.py", "d.py", "unknown", False, False), ("r/a.py", "r", "python", True, False), ("r/a.py", "r", "python", True, False), ("r/c.go", "r", "go", False, False), ("w\\b.go", "w", "java", False, True)]
    assert P.unparsed_files(df.limit(0)).count() == 0


def test_parse_texts(spark):
    df = spark.createDataFrame([(1, TEXTS["go"], "python"), (2, TEXTS["web"], None), (3, None, "go"), (4, "x", "klingon")], "i long, t string, g string")
    assert sorted(tuple(r) for r in P.parse_texts(df, "i", "t", "g").collect()) == [("1", "python", False, "go"), ("2", "web", True, None), ("3", "go", True, None)]


@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repair_loses_nothing(sequence):
    left, uses = R.infer(sequence)
    assert [t for s in left for t in s.split(R.SEP)] == sequence
    pairs = Counter(zip(left, left[1:]))
    assert not uses or all(n >= 1 for n in uses.values())
    assert all(n == 1 or a == b for (a, b), n in pairs.items()) or len(left) < len(sequence)


def test_rules_over_a_table(spark):
    df = spark.createDataFrame([(["x", str(i), "a", "b", "c"],) for i in range(20)] + [(None,), ([],)], "tokens array<string>")
    grammar = R.infer_rules(df, "tokens", rounds=3, least=10)
    left, used = R.derive(["q", "a", "b", "c"], grammar)
    assert "".join(left).replace(R.SEP, "") == "qabc" and R.SEP.join("abc") in used
    assert R.infer_rules(df.limit(0), "tokens") == []



def test_every_pair_with_enough_uses_gets_a_rule(spark):
    common = spark.range(1600 * 17).selectExpr("array(concat('a', id % 1600), concat('b', id % 1600)) AS tokens")
    rare = spark.range(16).selectExpr("array('m', 'k') AS tokens")
    grammar = R.infer_rules(common.unionByName(rare).unionByName(spark.range(15).selectExpr("array('p', 'q') AS tokens")), "tokens")
    assert len(set().union(*grammar)) == 1601 and ("m", "k") in grammar[0]
    assert R.admit([("a", "b", 3), ("b", "c", 2), ("x", "a", 1), ("a", "c", 1)]) == {("a", "b"), ("a", "c")}


MADE = [
    ("r/s/p/node_modules/k/i.js", "vendored"), ("r/vendor/p/k/x.go", "vendored"), ("r\\a\\Carthage\\Checkouts\\K\\x.py", "vendored"), ("r/s/deps/kit/a.ts", "vendored"), ("r/s/x_pb2.py", "generated"), ("r/s/x_pb2_grpc.py", "generated"),
    ("r/s/x.pb.go", "generated"), ("r/s/x.pb-c.c", "generated"), ("r/s/generated/x.py", "generated"), ("r/s/zz_generated.x.go", "generated"), ("r/s/mock_x.go", "generated"), ("r/s/moc_x.cpp", "generated"), ("r/s/lex.x.yy.c", "generated"),
    ("r/s/x.tab.c", "generated"), ("r/s/X.Designer.cs", "generated"), ("r/s/obj/Debug/X.g.i.cs", "generated"), ("r/s/_generated_x.py", "generated"), ("r/s/x.freezed.dart", "generated"), ("r/s/x.min.mjs", "minified"), ("r/s/X.MIN.JS", "minified"),
    ("r/s/x-min.js", "minified"), ("r/s/x.umd.prod.js", "minified"), ("r/s/x.bundle.js", "minified"), ("r/s/chunk-x_y.0fcbdf.js", "minified"), ("r/s/dist/x.e484ed.js", "minified"), ("r/s/public/assets/x-c5f343.js", "minified"),
]
HAND = [
    "r/s/vendors/x.go", "r/s/vendor_portal/x.go", "r/s/third_party_auth_x.ts", "r/s/external_refs_x.ts", "r/s/dependencies_x.c", "r/s/bundle_loader.c", "r/s/minimum_x.ts", "r/s/min_heap.js", "r/s/regenerate_x.py", "r/s/mocked_x.go", "r/s/generation/x.py",
    "r/s/distance/x.py", "r/s/distribute/x.js", "r/s/codegen/emit.go", "r/s/generator_x.ts", "r/s/chunk_frame.cpp", "r/s/chunk.ts", "r/s/x_copy.ts", "r/s/x_build.ts", "r/s/admin.js", "r/s/unminified.js", "deps.py", "r/external.ts", "r/s/facade.js", "",
]


@pytest.mark.parametrize("path, kind", MADE)
def test_markers(path, kind):
    assert H.marker_kind(path) == kind


@pytest.mark.parametrize("path", HAND)
def test_handwritten(path):
    assert H.marker_kind(path) is None


SCHEMA = "path string, content_hash string, generated boolean, size long, node_count int, kind string"


def test_machine_made(spark):
    data = [
        ("r/a.py", "h1", True, 10, 1, "x"), ("r/b.py", "known", False, 10, 1, "x"), ("r/c.py", None, None, 500_000, 0, "x"), ("r/d.py", "h", False, 500_000, 100, "x"), ("r/e.py", "h", False, None, None, None), (None, "h", True, 1, 1, "x"),
        ("r/f.py", "h", None, 2_000_000, None, "x"), ("r/x/node_modules/k/f.js", "h", None, 1, 1, "x"),
    ]
    known = spark.createDataFrame([("known",), ("known",), (None,)], "content_hash string")
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(tuple(r) for r in H.machine_made(df, known).collect()) == [("r/a.py", "flagged"), ("r/b.py", "copied"), ("r/c.py", "data"), ("r/f.py", "data"), ("r/x/node_modules/k/f.js", "vendored")]
    assert H.machine_made(df.limit(0), known.limit(0)).count() == 0


def test_rules_learn_a_marker_nobody_published(spark):
    data = [(f"r{i % 5}/p/w{i}.autoform.ts", f"h{i}", i % 2 == 0, 10, 1, "x") for i in range(80)] + [(f"r{i % 5}/p/w{i}.ts", f"g{i}", False, 10, 1, "x") for i in range(800)]
    got = {r["path"]: r["kind"] for r in H.machine_made(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], "content_hash string")).collect()}
    assert sum(k == "generated" for k in got.values()) == 40 and len(got) == 80


def test_text_profiles(spark):
    body = "push(alpha, beta, gamma, delta); push(alpha, beta, gamma, delta); "
    data = [("1", "p", body), ("2", "q", body), ("3", "q", "x = '" + "Zq9" * 50 + "'"), ("4", None, ""), ("5", "p", None)]
    got = {r["id"]: r for r in H.text_profiles(spark.createDataFrame(data, "i string, g string, t string"), "i", "t", "g").collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["1"]["reuse"] > 0.8 and got["1"]["shared_rules"] >= 1 and got["3"]["literal_share"] > 0.9 and got["4"]["tokens"] == 0


def test_seed_rules_and_learned_rules_are_told_apart(spark):
    data = [(f"r{i % 5}/p/W{i}Grpc.cs", f"h{i}", i % 2 == 0, 10, 1, "x") for i in range(80)] + [(f"r{i % 5}/p/node_modules/k/w{i}.ts", f"g{i}", False, 10, 1, "x") for i in range(40)]
    data += [(f"r{i % 5}/p/w{i}.cs", f"k{i}", False, 10, 1, "x") for i in range(800)]
    df, known = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], "content_hash string")
    kinds = [Counter(r["kind"] for r in H.machine_made(df, known, seeds=s).collect()) for s in (True, False)]
    assert kinds == [Counter(flagged=40, generated=40, vendored=40), Counter(flagged=40, generated=40)]


@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), min_size=1, max_size=8), st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), max_size=4))
def test_batches_of_symbols_are_shortened_like_single_sequences(rows, rules):
    import numpy as np

    rules = set(rules)
    want = [[R.token_symbol(t) if R.SEP not in t else R.rule_symbol(*map(R.token_symbol, t.split(R.SEP))) for t in R.replace(s, rules)] for s in rows]
    symbols, row = np.array([R.token_symbol(t) for s in rows for t in s], np.int64), np.repeat(np.arange(len(rows)), [len(s) for s in rows])
    out, at, _, _ = R.shorten(symbols, row, R._ordered({tuple(map(R.token_symbol, p)) for p in rules}))
    assert [out[at == i].tolist() for i in range(len(rows))] == want


def test_source_texts(spark):
    texts = list(TEXTS.values())[:-1] + ["We import goods from Spain.", "The class was late (again).", "", None]
    assert [P.is_source(t) for t in texts] == [True] * 8 + [False] * 4
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert P.source_texts(df, "t").count() == 8


def test_rules_do_not_depend_on_the_size(spark, monkeypatch):
    """A pair with 16 uses is a rule in a table of any number of tokens."""
    df = spark.range(16).selectExpr("array('p', 'q') AS tokens").unionByName(spark.range(400).selectExpr("array(concat('a', id), concat('b', id), concat('c', id)) AS tokens"))
    monkeypatch.setattr(R, "TOKENS_PER_RULE", 10, raising=False)
    assert R.infer_rules(df, "tokens") == [{("p", "q")}]
