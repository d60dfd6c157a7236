import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.llm import lookalike as L
from graphloom.llm.lookalike import LOOKALIKES, Speller, fit_scripts, lookalike_pairs, normalise, skeleton

SAME = [
    ("file", "ﬁle"), ("a b", "a\u00a0b"), ("a b", "a\u2007b"), ("pass", "p\u0430ss"), ("Tok", "\u03a4\u043ek"), ("ab", "a\u200bb"), ("ab", "a\u00adb"), ("ab", "\ufeffab"), ("abc1", "ａｂｃ１"),
    ("é", "e\u0301"), ("ё", "ë"), ("й", "и\u0306"), ("a-b", "a\u2011b"), ("a\nb", "a\r\nb"), ("ﷲ"[:0] + "office", "oﬃce"), ("IV", "Ⅳ"),
]
DIFFERENT = [("x2", "x²"), ("a", "á"), ("a", "A"), ("ab", "a b"), ("word", "ward"), ("a", "ａｂ"), ("ı", "i"), ("l", "I"), ("①", "1"), ("𝐚", "a"), ("a\nb", "a b"), ("ß", "ss"), ("œ", "oe")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_looks(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_visible_differences(a, b):
    assert skeleton(a) != skeleton(b)


def test_table_is_one_class_each():
    seen: dict = {}
    for name, others in LOOKALIKES.items():
        for c in others:
            assert seen.setdefault(c, name) == name


def test_script_model_restores_words(spark):
    texts = ["проверьте список после перехода образ", "please check the cache of the parser", "список", None, ""] * 20
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    speller = Speller(fit_scripts(df, "text"))
    assert speller.text("п\u0440ов\u0435рьте c\u043fиcoк") == "проверьте список"
    assert speller.text("\u0441\u0430che \u043ef th\u0435") == "cache of the"


CHARS = st.text(alphabet="abcосЕEо ﬁ\u200b\u0301e1¹\n", max_size=12)


@settings(max_examples=60, deadline=None)
@given(CHARS, CHARS)
def test_form_is_shared_exactly_by_equal_looks(a, b):
    speller = Speller({"pair": {"ab": 3, "^a": 2, "ос": 4, "сЕ": 1}, "one": {"a": 3, "^": 5, "о": 4}})
    assert (speller.text(a) == speller.text(b)) == (skeleton(a) == skeleton(b))
    assert skeleton(speller.text(a)) == skeleton(unicodedata.normalize("NFC", skeleton(a)))


def test_pairs(spark):
    data = [(1, "pass"), (2, "p\u0430ss"), (3, "pass"), (4, "Pass"), (5, None), (6, ""), (7, "\u200b"), (8, "paß"), (9, "x" * 60_000), (10, "\u0445" * 60_000), (1, "pass")]
    df = spark.createDataFrame(data, "d long, t string").selectExpr("*", "1 AS id", "2 AS class_id", "3 AS form")
    got = sorted(tuple(r) for r in lookalike_pairs(df, "d", "t").collect())
    assert got == [(1, 2), (2, 3), (6, 7), (9, 10)]
    assert lookalike_pairs(df.limit(0), "d", "t").count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), CHARS), max_size=8))
def test_pairs_equal_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    want = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and None not in (a, b) and a != b and skeleton(a) == skeleton(b)]
    assert sorted(tuple(r) for r in lookalike_pairs(df, "d", "t").collect()) == want


def test_normalise_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ﬁn", [1]), (2, None, None)], "i long, t string, x array<int>")
    out = sorted(tuple(r) for r in normalise(df, "t", "f").collect())
    assert out == [(1, "ﬁn", [1], "fin"), (2, None, None, None)]
    with pytest.raises(ValueError):
        normalise(df, "t", "X")


def test_the_score_decides_unsure_characters():
    words = {"hello": 400, "client": 300, "password": 300, "plugin": 300, "field": 200, "coral": 200}
    pair, one = {}, {}
    for word, n in words.items():
        for a, b in zip("^" + word, word + "$"):
            pair[a + b] = pair.get(a + b, 0) + n
            one[a] = one.get(a, 0) + n
    scored, plain = L.Speller({"pair": pair, "one": one}), L.Speller({"pair": pair, "one": one}, scored=False)
    for odd, even in (("he1lo", "hello"), ("c1ient", "client"), ("passw0rd", "password"), ("pIugin", "plugin"), ("the fie1d of c0ral", "the field of coral")):
        assert scored.text(odd) == even == scored.text(even) and plain.text(odd) == odd
    for kept in ("v10", "x1y", "91dc0cfb", "sha1", "getItem", "10", "", "1", "I", "a0"):
        assert scored.text(kept) == kept


def test_classes_say_in_one_row_what_pairs_say(spark):
    texts = ["a cat", "a cat", "а cat", "a​ cat", "a dog", None, "", "A cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").selectExpr("*", "1 AS id", "2 AS class_id")
    got = {r["id"]: (r["class_id"], r["n_rows"], r["n_links"]) for r in L.lookalike_classes(df, "i", "t").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6, 7] and len({got[i][0] for i in range(4)}) == 1
    assert [got[i][1:] for i in range(5)] == [(4, 2), (4, 2), (4, 3), (4, 3), (None, 0)]
    pairs = {tuple(r) for r in L.lookalike_pairs(df, "i", "t").collect()}
    assert len(pairs) * 2 == sum(n for _, _, n in got.values()) and (0, 1) not in pairs
