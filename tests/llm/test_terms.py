from collections import Counter, defaultdict

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.llm.terms import global_dictionary, term_frequencies

SCHEMA = "id string, a string, b string, extra int"


def brute(data, rare, common):
    occ, rec = Counter(), defaultdict(set)
    best: dict = {}
    for i, a, b, _ in data:
        if i is not None:
            x, y = best.get(i, (None, None))
            best[i] = tuple(max((v for v in pair if v is not None), default=None) for pair in ((x, a), (y, b)))
    for i, texts in best.items():
        for t in texts:
            for run in regex.findall(r"[\p{L}\p{Nd}]+", t or ""):
                for p in regex.split(r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", run):
                    if regex.search(r"\p{L}", p):
                        occ[p.lower()] += 1
                        rec[p.lower()].add(i)
    n = len(best)
    return {t: (c, len(rec[t]), "rare" if len(rec[t]) < rare else "common" if len(rec[t]) > common * n else None) for t, c in occ.items()}


def run(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_frequencies(df, "id", ["a", "b"], **kw).collect()}


TEXT = st.one_of(st.none(), st.sampled_from(["", "getHTTPServer2", "a_b::a", "Größe größe", "x1Y2", "123", "ΑΒγ", "foo.foo foo", "_" * 3]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("pqrs")), TEXT, TEXT, st.just(1)), max_size=12))
def test_equals_brute_force(spark, data):
    assert run(spark, data, rare_below=2, common_above=0.6) == brute(data, 2, 0.6)


def test_repeated_rows_long_texts_and_ranges(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.terms.RANGE", 8)
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q" for i in range(3000))
    data = [("1", long, None, 1)] * 3 + [("2", "waaq", "waaq", 1)]
    got = run(spark, data)
    assert got["waaq"] == (brute(data, 3, 0.05)["waaq"]) and len(got) == len(brute(data, 3, 0.05))


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_dictionary_is_dense(spark):
    d = global_dictionary(spark.createDataFrame([(c,) for c in "zebra-apple"], "term string"))
    got = sorted((r["term_id"], r["term"]) for r in d.collect())
    assert [i for i, _ in got] == list(range(len(set("zebra-apple")))) and [t for _, t in got] == sorted(set("zebra-apple"))
