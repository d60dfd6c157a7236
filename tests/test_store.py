import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from graphloom.operators import store as S

NODE = "id string, updated_at timestamp, kind string, name string, file_path string, language string"
EDGE = "id long, source string, target string, kind string, line int, col int"


def ts(n):
    return dt.datetime(2024, 1, n)


def small(spark):
    nodes = spark.createDataFrame([(i, ts(1), "function", i, f"{i}.py", "python") for i in "abc"], NODE)
    edges = spark.createDataFrame([(1, "a", "b", "calls", None, None), (2, "b", "c", "calls", 3, 1), (3, "a", "a", "contains", None, None)], EDGE)
    files = spark.createDataFrame([(f"{i}.py", f"h{i}", ts(1)) for i in "abc"], "path string, content_hash string, indexed_at timestamp")
    refs = spark.createDataFrame([(1, "a", "x", "calls", 1, 1, "a.py", "failed", "x")], "id long, from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, status string, name_tail string")
    return S.Snapshot(nodes, edges, files, refs)


def test_newest_takes_greatest_and_nulls_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 5), ("a", 3, 4), ("a", 3, 4), (None, 9, 9)], "k string, o int, v int")
    assert rows(S.newest(df, "k", "o")) == [("a", 3, 4)]


def test_edge_identity_folds_nulls_and_keeps_first(spark):
    df = spark.createDataFrame([(5, "a", "b", "calls", None, None), (4, "a", "b", "calls", None, None), (6, "a", "b", "calls", 1, None)], EDGE)
    assert [r[0] for r in rows(S.dedup_edges(df))] == [4, 6]


def test_orphans_are_dropped(spark):
    s = small(spark)
    assert S.drop_orphans(s.edges, s.nodes.where("id <> 'c'")).count() == 2


def test_delete_cascades(spark):
    less = small(spark).delete_files(spark.createDataFrame([("a.py",)], "path string"))
    assert rows(less.nodes.select("id")) == [("b",), ("c",)] and less.edges.count() == 1 and less.refs.count() == 0 and less.files.count() == 2


def test_upsert_replaces_and_skips_partial_rows(spark):
    s = small(spark)
    new = spark.createDataFrame([("a", ts(2), "class", "A", "a.py", "python"), ("z", ts(2), None, "z", "z.py", "python")], NODE)
    assert rows(s.upsert_nodes(new).nodes.select("id", "kind")) == [("a", "class"), ("b", "function"), ("c", "function")]


def test_insert_ignores_existing_and_orphans(spark):
    s = small(spark)
    more = spark.createDataFrame([(9, "a", "b", "calls", None, None), (10, "a", "c", "calls", 1, 1), (11, "a", "q", "calls", 1, 1)], EDGE)
    assert rows(s.insert_edges(more).edges.select("id")) == [(1,), (10,), (2,), (3,)]


def test_replace_file_moves_edges_or_parks_them(spark):
    s = small(spark)
    file = spark.createDataFrame([("b.py", "new", ts(2))], "path string, content_hash string, indexed_at timestamp")
    same = spark.createDataFrame([("b2", ts(2), "function", "b", "b.py", "python")], NODE)
    moved = s.replace_files(same, s.edges.limit(0), file)
    assert rows(moved.edges.where("source = 'a' and kind = 'calls'").select("target")) == [("b2",)]
    other = spark.createDataFrame([("q", ts(2), "function", "q", "b.py", "python")], NODE)
    parked = s.replace_files(other, s.edges.limit(0), file)
    assert rows(parked.refs.where("status = 'pending'").select("from_node_id", "reference_name")) == [("a", "b")]


def test_incremental_equals_rebuild(spark):
    s = small(spark)
    new = spark.createDataFrame([("b", ts(3), "function", "b", "b.py", "python")], NODE)
    file = spark.createDataFrame([("b.py", "h2", ts(3))], "path string, content_hash string, indexed_at timestamp")
    own = s.edges.where("source = 'b'")
    after = s.replace_files(new, own, file)
    assert rows(after.edges.select("source", "target", "kind")) == rows(s.edges.select("source", "target", "kind"))
    assert rows(after.nodes.select("id")) == rows(s.nodes.select("id"))


def test_hash_diff_and_definition_delta(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "path string, content_hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4")], "path string, content_hash string")
    assert rows(S.hash_diff(a, b)) == [("w", "added"), ("y", "modified"), ("z", "removed")]
    c, d = a.select(F.col("path").alias("file_path"), F.lit("n").alias("name")), b.select(F.col("path").alias("file_path"), F.lit("n").alias("name"))
    assert rows(S.definition_delta(c, d)) == [("w", "n", "added"), ("z", "n", "removed")]


def test_retry_has_a_ceiling(spark):
    refs = spark.createDataFrame([(i, "t", "failed") for i in range(3)] + [(9, "u", "failed")], "id long, name_tail string, status string")
    names = spark.createDataFrame([("t",), ("u",)], "name string")
    assert rows(S.retry_failed(refs, names, ceiling=2).select("id")) == [(9,)]
