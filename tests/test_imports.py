import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.operators import imports as M
from graphloom.operators import synthesize as Y
from graphloom.plans import context as P
from graphloom.plans import surveys as V

FILES = [
    "src/a/main.ts", "src/a/util.ts", "src/b/index.ts", "lib/x.c", "lib/x.h", "inc/y.h", "app/pkg/mod.py", "app/pkg/__init__.py", "app/other.py", "j/com/acme/Shop.java", "r/net/http.rs", "r/net/mod.rs", "l/a/b.lua", "n/default.nix", "p/inc/top.php", "p/index.php",
    "c/COPY1.cpy".lower(), "g/store/store.go",
]


def nodes(spark):
    return spark.createDataFrame([(f"file:{p}", "file", p.rsplit("/", 1)[-1], p, "x", 1) for p in FILES] + [("go:Open", "function", "Open", "g/store/store.go", "go", 3)], "id string, kind string, name string, file_path string, language string, start_line int")


def refs(spark, data):
    return spark.createDataFrame([(i, n, k, p, g, n.split(".")[-1]) for i, (n, k, p, g) in enumerate(data)], "ref_id long, reference_name string, reference_kind string, ref_path string, ref_language string, tail string")


CASES = [
    ("./util", "src/a/main.ts", "typescript", "src/a/util.ts", 0.9), ("../b", "src/a/main.ts", "typescript", "src/b/index.ts", 0.9), ("@/a/util", "x/y.ts", "typescript", "src/a/util.ts", 0.9), ("x.h", "lib/x.c", "c", "lib/x.h", 0.92),
    ("y.h", "lib/x.c", "c", "inc/y.h", 0.9), ("pkg.mod", "app/other.py", "python", "app/pkg/mod.py", 0.9), ("pkg.mod.thing", "app/other.py", "python", "app/pkg/mod.py", 0.85), (".mod", "app/pkg/__init__.py", "python", "app/pkg/mod.py", 0.9),
    ("com.acme.Shop", "j/Main.java", "java", "j/com/acme/Shop.java", 0.9), ("crate::net::http", "r/main.rs", "rust", "r/net/http.rs", 0.9), ("a.b", "l/main.lua", "lua", "l/a/b.lua", 0.9), ("./default.nix", "n/x.nix", "nix", "n/default.nix", 0.9),
    ("inc/top.php", "p/index.php", "php", "p/inc/top.php", 0.9), ("COPY1", "c/main.cbl", "cobol", "c/copy1.cpy", 0.9), ("nowhere", "src/a/main.ts", "typescript", None, None),
]


def test_imports_find_files(spark):
    r = refs(spark, [(n, "imports", p, g) for n, p, g, *_ in CASES])
    got = {x["ref_id"]: (x["target_path"], x["confidence"]) for x in M.to_files(r, nodes(spark), ("inc",), {"@/": "src/"}).collect()}
    assert got == {i: (t, c) for i, (_, _, _, t, c) in enumerate(CASES) if t}


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../../x",), ("",)], "p string")
    assert [r[0] for r in df.select(M.normal_path(F.col("p"))).collect()] == ["a/c", "x", ""]


def test_go_packages(spark):
    r = refs(spark, [("acme.io/g/store", "imports", "g/main.go", "go"), ("store.Open", "calls", "g/main.go", "go"), ("store.Open", "calls", "g/other.go", "go")])
    assert rows(M.go_packages(r, nodes(spark)).select("ref_id", "target")) == [(1, "go:Open")]


def test_named_imports_follow_reexports(spark):
    uses = spark.createDataFrame([(1, "m.ts", "Foo"), (2, "m.ts", "ns.bar"), (3, "m.ts", "Lost"), (4, "m.ts", "Loop")], "ref_id long, ref_path string, reference_name string")
    maps = spark.createDataFrame([("m.ts", "Foo", "Foo", "i.ts"), ("m.ts", "ns", "*", "b.ts"), ("m.ts", "Lost", "Lost", "i.ts"), ("m.ts", "Loop", "Loop", "q.ts")], "file_path string, local_name string, imported_name string, target_path string")
    re_ = spark.createDataFrame([("i.ts", "Foo", "RealFoo", "f.ts"), ("i.ts", "*", "*", "g.ts"), ("q.ts", "*", "*", "q.ts")], "file_path string, name string, source_name string, source_path string")
    n = spark.createDataFrame([("x1", "class", "RealFoo", "f.ts", 1), ("x2", "function", "bar", "b.ts", 1)], "id string, kind string, name string, file_path string, start_line int")
    assert rows(M.named_imports(uses, maps, n, re_, hops=3).select("ref_id", "target")) == [(1, "x1"), (2, "x2")]


@pytest.mark.parametrize(
    "language, text, role, key, handler",
    [
        ("typescript", "app.get('/x', auth, listAll)", "route:express", "/x", "listAll"), ("typescript", "@Get('y')\nasync find(@Q() q) {", "route:nestjs", "y", "find"), ("python", "@app.route('/z')\n@login\ndef show():\n", "route:flask", "/z", "show"),
        ("python", "@r.get('/z')\nasync def show():\n", "route:fastapi", "/z", "show"), ("python", "path('a/', views.home)", "route:django", "a/", "views.home"), ("ruby", "get '/u', to: 'users#index'", "route:rails", "/u", "users#index"),
        ("php", "Route::get('/u', [U::class, 'index'])", "route:laravel", "/u", "index"), ("java", '@GetMapping("/p")\npublic List<A> all(', "route:spring", "/p", "all"), ("go", 'r.GET("/g", h.List)', "route:go-http", "/g", "h.List"),
        ("rust", '.route("/r", get(list))', "route:rust-axum", "/r", "list"), ("csharp", '[HttpGet("c")]\npublic async Task<A> Get(', "route:aspnet", "c", "Get"), ("tsx", '<Route path="/h" element={<Home', "route:react-router", "/h", "Home"),
        ("objc", "RCT_EXPORT_METHOD(open:(id)x)", "route:react-native", "open", "open"), ("terraform", 'resource "aws_x" "main" {', "route:terraform", "aws_x", "main"), ("swift", 'app.get("v", use: ctl.list)', "route:vapor", "v", "list"),
    ],
)
def test_routes(language, text, role, key, handler):
    assert (role, key, handler) in [s[2:5] for s in Y.sites_of("f", text, language)]


def test_synthesized_edges(spark):
    text = "function add(f) { this.subs.push(f2); }\nfunction fire() { for (const s of this.subs) s(); }\nfunction f2() {}\nfunction go() { bus.emit('done'); }\nbus.on('done', f2);\n// bus.on('done', add)\n"
    files = spark.createDataFrame([("m.ts", text, "typescript"), ("c.c", "void cb() {}\nstruct ops o = { .open = cb };\nvoid run(struct ops *p) {\n  p->open();\n}\n", "c"), ("n.ts", None, "typescript")], "path string, text string, language string")
    data = [("add", 1, 1), ("fire", 2, 2), ("f2", 3, 3), ("go", 4, 4)]
    n = spark.createDataFrame([(x, "function", x, "m.ts", a, b) for x, a, b in data] + [("cb", "function", "cb", "c.c", 1, 1), ("run", "function", "run", "c.c", 3, 5)], "id string, kind string, name string, file_path string, start_line int, end_line int")
    found = Y.sites(files)
    assert rows(Y.observer_edges(found, n).select("source", "target")) == [("fire", "f2")]
    assert rows(Y.event_edges(found, n).select("source", "target")) == [("go", "f2")]
    assert rows(Y.pointer_edges(found, n).select("source", "target")) == [("run", "cb")]
    web = Y.sites(spark.createDataFrame([("m.ts", "app.get('/x', f2)", "typescript")], "path string, text string, language string"))
    assert rows(Y.route_edges(web, n).select("source", "target", "framework")) == [("route:m.ts:/x", "f2", "express")]


def test_request_type_routes(spark):
    n = spark.createDataFrame([("r", "route", "go", "x goframe-route:v1.HelloReq", "api/a.go", 1, None), ("h", "method", "go", "q", "ctl/a.go", 2, "(c *C) Hello(ctx X, req *v1.HelloReq)"), ("o", "method", "go", "q", "ctl/a.go", 3, "(req *v1.Other)")], "id string, kind string, language string, qualified_name string, file_path string, start_line int, signature string")
    assert rows(Y.request_type_routes(n).select("source", "target")) == [("r", "h")]


def test_surveys(spark):
    f = spark.createDataFrame([("a.ts", "import { x } from 'kit/net';\nconst foo = x.go();\nclass Foo {}\n", 10), ("x.d.ts", "export declare class Foo {}\n", 10), ("b.ts", "import './x';\nlog('go')\n", 10), ("package.json", "{}", 2), ("n.c", 'static T t[] = {\n  { "open", f },\n};', 9), ("z.ts", None, None)], "path string, text string, size long")
    assert rows(V.import_sites(f, ["kit/net"]).select("path", "line")) == [("a.ts", 1)]
    assert rows(V.member_usage(f, "go").select("path", "line")) == [("a.ts", 2), ("b.ts", 2)]
    assert rows(V.declaration_sites(f, "Foo").select("path")) == [("a.ts",), ("x.d.ts",)]
    assert rows(V.api_usage(f, ["Foo"]).select("path", "n_lines", "is_stub")) == [("a.ts", 1, False), ("x.d.ts", 1, True)]
    assert rows(V.declaration_file_wraps(f)) == [("x.d.ts", "b.ts", 1)]
    assert rows(V.config_files(f).select("path")) == [("package.json",)]
    assert rows(V.export_surface(f).select("line", "name")) == [(2, "open")]


def test_context_and_diff(spark):
    cols = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string"
    n = spark.createDataFrame([("a", "function", "loadCache", "x::loadCache", "src/x.ts", "ts", 1, 9, "Loads.", "()"), ("b", "class", "Cache", "x::Cache", "src/x.ts", "ts", 10, 50, None, None), ("c", "function", "caller", "y::caller", "src/y.ts", "ts", 1, 5, None, None), ("t", "function", "cacheTest", "t", "test/t.ts", "ts", 1, 2, None, None)], cols)
    e = spark.createDataFrame([(1, "c", "a", "calls", 2, 1), (2, "a", "b", "references", 3, 1)], "id long, source string, target string, kind string, line int, col int")
    kept, among = P.context(n, e, "Who uses `loadCache`?", roots=2)
    got = {r["id"]: r["is_root"] for r in kept.collect()}
    assert got["a"] is True and "c" in got and among.count() == 2
    text = P.as_markdown(kept, among)
    assert text.startswith("### ") and "loadCache" in text and len(P.as_markdown(kept, among, 40)) <= 40
    assert P.as_json(kept, among).count() == len(got) + 2
    ranges = spark.createDataFrame([("src/x.ts", 3, 4)], "path string, r_start int, r_end int")
    d = P.diff_impact(n, e, ranges).first()
    assert (d["id"], d["n_users"], d["n_impacted"]) == ("a", 1, 1)
    assert P.symbols_in_prose("call `foo_bar` or Http.Client and getX()") == ["foo_bar", "getX", "Http", "Client"]
