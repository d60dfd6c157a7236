from collections import Counter

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators.skew import heavy_hitters, per_key, skew_join


def frame(spark, keys):
    return spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)], "k string, v int")


def test_heavy_hitters_never_miss(spark):
    keys = ["a"] * 300 + [None] * 200 + [f"x{i}" for i in range(2000)]
    heavy, n = heavy_hitters(frame(spark, keys).repartition(5), "k", 0.05)
    assert n == 2500 and {"a", None} <= set(heavy) and len(heavy) <= 40


def test_empty_table(spark):
    df = frame(spark, [])
    assert heavy_hitters(df, "k", 0.1) == ([], 0)
    assert per_key(df, "k", {"n": F.count(F.lit(1))}).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", None, "c", "", "ä"]), max_size=60))
def test_per_key_equals_plain_grouping(spark, keys):
    df = frame(spark, keys)
    got = rows(per_key(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"d": "v"}, share=0.2))
    want = rows(df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.countDistinct("v").alias("d")))
    assert got == want


def test_extra_columns_with_clashing_names(spark):
    df = frame(spark, ["a", "b", "a"]).withColumn("heavy_k", F.lit(1)).withColumn("__v", F.lit(2)).withColumn("n", F.lit(3))
    assert rows(per_key(df, "k", {"n": F.count(F.lit(1))}, {"d": "v"}, share=0.5)) == [("a", 2, 2), ("b", 1, 1)]
    with pytest.raises(ValueError):
        per_key(df, "k", {"k": F.count(F.lit(1))})


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [200_000, 0])
def test_skew_join(spark, monkeypatch, how, limit):
    monkeypatch.setattr("graphloom.operators.skew.BROADCAST_ROWS", limit)
    left = frame(spark, ["a"] * 50 + ["b", "c", None, None])
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "rk string, w int")
    got = Counter(map(tuple, skew_join(left, right, "k", "rk", how, share=0.3).collect()))
    want = Counter(map(tuple, left.join(right, F.col("k") == F.col("rk"), how).collect()))
    assert got == want
    with pytest.raises(ValueError):
        skew_join(left, left, "k", "k")
