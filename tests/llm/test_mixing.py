import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.llm.mixing import TOKENIZER, count_tokens, mix_sources


def mix(spark, data, targets, **kw):
    df = spark.createDataFrame(data, "id long, source string, tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mix_sources(df, t, "id", "source", "tokens", **kw)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None, "z"]), st.one_of(st.none(), st.integers(0, 9))), max_size=25))
def test_budgets(spark, data):
    rows = [(i, s, n) for i, (s, n) in enumerate(data)]
    m = mix(spark, rows, [("a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 5)])
    total = sum(n for s, n in data if s in ("a", "b") and n is not None)
    chosen = m.records.collect()
    assert len({r["id"] for r in chosen}) == len(chosen)
    for source, share, most in (("a", 0.3, 1), ("b", 0.6, 3)):
        mine = [r for r in chosen if r["source"] == source]
        have, got, budget = sum(n for s, n in data if s == source and n is not None), sum(r["tokens"] * r["copies"] for r in mine), int(share * total)
        assert got <= budget and all(1 <= r["copies"] <= most for r in mine)
        longest = max((n for s, n in data if s == source and n is not None), default=0)
        assert got >= min(budget, have * most) - longest if have else got == 0
    report = {r["source"]: r for r in m.shares.collect()}
    assert set(report) == {"a", "b", "none"} and report["none"]["chosen_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in report.values()) - (1 if any(r["tokens"] for r in chosen) else 0)) < 1e-9


def test_epochs_and_caps(spark):
    m = mix(spark, [(1, "s", 10), (2, "s", 10), (3, "big", 980)], [("s", 0.05, 2), ("big", 0.9, 1)])
    got = {r["id"]: r["copies"] for r in m.records.collect()}
    assert got[1] == got[2] == 2 and 3 not in got
    report = {r["source"]: r for r in m.shares.collect()}
    assert report["s"]["limited"] and report["s"]["chosen_tokens"] == 40 and not report["big"]["limited"]


def test_repeatable_and_seeded(spark):
    data = [(i, "s", 5) for i in range(200)]
    one = sorted(r["id"] for r in mix(spark, data, [("s", 0.5, 1)]).records.collect())
    assert one == sorted(r["id"] for r in mix(spark, data, [("s", 0.5, 1)]).records.collect()) and len(one) == 100
    assert one != sorted(r["id"] for r in mix(spark, data, [("s", 0.5, 1)], seed=8).records.collect())


def test_empty(spark):
    m = mix(spark, [], [("s", 1.0, 1)])
    assert m.records.count() == 0 and m.shares.first()["chosen_tokens"] == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary here")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "word " * 20_000)], "i long, t string")
    got = {r["i"]: r["tokens"] for r in count_tokens(df, "t").collect()}
    assert got[1] == 2 and got[2] is None and got[3] == 0 and got[4] > 1 and got[5] >= 20_000
    with pytest.raises(ValueError):
        count_tokens(df, "t", "I")
