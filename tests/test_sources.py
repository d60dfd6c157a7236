import datetime as dt
import subprocess

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions import code as K
from graphloom.sources import extract as E
from graphloom.sources import files as S
from graphloom.sources.gitlog import GitCommits
from graphloom.streaming import changes as W

PY = 'import os\nfrom a import b as c\n\n@deco\nclass A(Base):\n    """Doc."""\n    def m(self, x):\n        return os.path.join(x)\n\ndef f():\n    A()\n'
TS = "// class Fake {\nexport class Shop {\n  private load(id: string): void {\n    fetchAll('x(');\n  }\n}\nconst go = (a) => {\n  new Shop().load(a);\n}\n"


def test_scan_detects_ignores_and_caps(spark, tmp_path):
    for path, text in {"a/x.py": "x = 1", "node_modules/y.js": "1", "b/big.ts": "x" * (S.SIZE_CAP + 1), "c.h": "class Q {};", "z.unknown": "?", "gen/k.py": "k"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r["path"]: r for r in S.scan(spark, str(tmp_path), ["gen/"]).collect()}
    assert set(got) == {"a/x.py", "b/big.ts", "c.h"} and got["b/big.ts"]["oversize"] and got["b/big.ts"]["text"] is None and got["c.h"]["language"] == "cpp"


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/b.log",), ("keep.log",), ("src/tmp/x",), ("tmpx/y",), ("docs/a/b.md",)], "p string")
    got = [r[0] for r in df.select(S.ignore_rules(F.col("p"), ["*.log", "!keep.log", "tmp/", "/docs/**/*.md"])).collect()]
    assert got == [True, False, True, False, True]


def test_headers_and_headings(spark):
    df = spark.createDataFrame([("// Code generated by x. DO NOT EDIT.\nfoo",), ("x = 'generated by'",), (None,)], "t string")
    assert [r[0] for r in df.select(S.generated_header(F.col("t"))).collect()] == [True, False, False]
    md = spark.createDataFrame([(1, "# Top\n\n## One\n## Two\n"), (2, "plain\nrest")], "id int, t string")
    assert rows(S.headings(md, "id", "t")) == [(1, "Top", ["One", "Two"]), (2, "plain", [])]


def test_extractors(spark):
    files = spark.createDataFrame([("a.py", PY, "python"), ("s.ts", TS, "typescript"), ("bad.py", "def (", "python"), ("n.py", None, "python"), ("q.zz", "x", "zz")], "path string, text string, language string")
    out = E.extract(files)
    nodes = {(r["kind"], r["qualified_name"]) for r in out.where("row_type = 'node'").collect()}
    assert {("class", "a.py::A"), ("method", "a.py::A::m"), ("function", "a.py::f"), ("class", "s.ts::Shop"), ("method", "s.ts::Shop::load"), ("function", "s.ts::go")} <= nodes
    assert not any("Fake" in q for _, q in nodes)
    refs = {(r["kind"], r["name"]) for r in out.where("row_type = 'ref'").collect()}
    assert {("imports", "os"), ("imports", "a.b"), ("extends", "Base"), ("decorates", "deco"), ("calls", "os.path.join"), ("calls", "A"), ("calls", "fetchAll")} <= refs
    assert [r["file_path"] for r in out.where("row_type = 'error'").collect()] == ["bad.py"]


def test_register_extractor(spark):
    E.register("toy", lambda path, text: iter([E._node(path, "toy", "file", path, path, 1, 1)]))
    assert E.extract(spark.createDataFrame([("t", "x", "toy")], "path string, text string, language string")).count() == 1


def test_strip_comments_and_dispatch(spark):
    assert K.strip_comments("a // x\nb '// no' /* y\nz */ c", "typescript") == "a     \nb '// no'     \n     c"
    assert K.strip_comments("x = '# no' # yes", "python").rstrip() == "x = '# no'"
    assert [(f, n) for f, n, _ in K.dispatch_sites("a.emit('go');\n// b.emit('no')\nx[k](1);", "typescript")] == [("event", 1), ("computed-member", 3)]
    assert K.truncate_lines("ab\ncd\nef", 6) == "ab\ncd"
    df = spark.createDataFrame([("a # b", "python"), (None, "go")], "t string, g string")
    assert [r[0] for r in df.select(K.without_comments("t", "g")).collect()] == ["a    ", None]


def test_git_log(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@x", *a], check=True, capture_output=True)

    git("init", "-q")
    for k in range(3):
        git("commit", "-q", "--allow-empty", "-m", f"msg {k}\n\nbody")
    spark.dataSource.register(GitCommits)
    got = spark.read.format("gitcommits").option("commitsPerPartition", "2").load(str(tmp_path))
    assert sorted(r["message"] for r in got.collect()) == [f"msg {k}\n\nbody" for k in range(3)]
    text = subprocess.run(["git", "-C", str(tmp_path), "log", "--format=%H%x1f%an%x1f%ct%x1f%B%x00"], capture_output=True).stdout
    (tmp_path / "log.txt").write_bytes(text)
    assert rows(S.read_git_log(spark, str(tmp_path / "log.txt"))) == rows(got)


def events(spark, data):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(p, base + dt.timedelta(milliseconds=ms)) for p, ms in data], "path string, ts timestamp")


def test_debounce_is_adaptive(spark):
    burst = [("a", 0), ("a", 100), ("b", 0), *[("c", k * 100) for k in range(5)], ("c", 1500)]
    got = {(r["path"], r["n_events"], r["gap_ms"]) for r in W.debounce(events(spark, burst), "path", "ts").collect()}
    assert got == {("a", 2, 300), ("b", 1, 300), ("c", 6, 2000)}
    assert [W.retry_delay_ms(n) for n in (1, 2, 5, 6)] == [2000, 4000, 30000, None]


def test_stream_equals_batch(spark, tmp_path):
    data = [("a", 0), ("a", 500), ("b", 100), ("a", 9000), ("z", 60_000), ("z", 120_000)]
    src = tmp_path / "in"
    events(spark, data).coalesce(1).write.parquet(str(src))
    stream = W.file_stream(spark, str(src), "path string, ts timestamp")
    got = []
    W.run_once(W.sessions(stream.withWatermark("ts", "1 second"), "path", "ts", "2 seconds"), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    want = rows(W.sessions(events(spark, data), "path", "ts", "2 seconds"))
    assert {g for g in got} <= set(want) and ("a", 2) in {(g[0], g[3]) for g in got}


def test_pending_set_waits_for_quiet(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, part in enumerate([[("a", 0), ("a", 1500), ("b", 0)], [("a", 3000), ("c", 30_000)], [("d", 90_000)]]):
        events(spark, part).coalesce(1).write.mode("append").parquet(src)
    out = []
    stream = W.file_stream(spark, src, "path string, ts timestamp", per_batch=1)
    W.run_once(W.pending_files(stream, 2000), lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    assert {r[0] for r in out} >= {"a", "b"} and sum(r[3] for r in out if r[0] == "a") == 3
    assert isinstance(pd.DataFrame(out), pd.DataFrame)


def test_header_scan_gives_texts_that_speak_of_generation(spark, tmp_path):
    from graphloom import plan_queries as Q

    data = [(1, "snippets", "// Code generated by x. DO NOT EDIT.\nf()"), (2, "snippets", "// do not panic\nf()"), (3, "snippets", "f()"), (4, "docs", "// @generated"), (5, "snippets", None)]
    spark.createDataFrame(data, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(Q.header_scan(spark, str(tmp_path))) == [(1, True), (2, False), (3, False)]
