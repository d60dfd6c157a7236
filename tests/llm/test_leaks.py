from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.leaks import ItemIndex, tile_leaks, words


def longest_run(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


WORDS = st.lists(st.sampled_from("a b c d e".split()), max_size=30)


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_tiles_against_brute_force(doc, item):
    index = ItemIndex([(7, " ".join(item))], 3)
    got = list(index.tile(index.encode(" ".join(doc))))
    longest = longest_run(doc, item)
    if longest < 3:
        assert got == []
    else:
        [(k, best, tiles, covered, n)] = got
        assert index.ids[k] == 7 and best == longest and tiles >= 1 and best <= covered <= n == len(item)


def test_reordered_passages_are_covered():
    index = ItemIndex([(1, "a b c d e f g h i j")], 4)
    [(_, longest, tiles, covered, _)] = list(index.tile(index.encode("x g h i j y a b c d e z")))
    assert (longest, tiles, covered) == (5, 2, 9)


def test_words_ignore_form():
    assert words("ＦＯＯ-b\u0430r,\n\u200bBaz_9") == ["foo", "bar", "baz", "9"]


def test_leaks_of_tables(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(1, item), (2, "x " + " ".join(f"W{k}," for k in range(3, 18))), (3, " ".join(f"w{k}" for k in range(14))), (4, None), (5, ""), (6, "pad " * 50_000 + item), (1, item), (7, item.replace("w", "\uff57"))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS item_id", "1 AS longest")
    items = spark.createDataFrame([(10, item), (11, "short one"), (12, None), (10, item)], "item_id long, text string")
    got = sorted({(r["doc_id"], r["item_id"]) for r in tile_leaks(d, items).collect()})
    assert got == [(1, 10), (2, 10), (6, 10), (7, 10)]
    assert tile_leaks(d.limit(0), items).count() == 0 and tile_leaks(d, items.limit(0)).count() == 0


def test_many_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"i{k}x{j}" for j in range(16))) for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"i{k}x{j}" for j in range(16))) for k in range(9)], "doc_id long, text string")
    monkeypatch.setattr("graphloom.llm.leaks.BLOCK_CHARS", 200)
    assert sorted((r[0], r[1]) for r in tile_leaks(docs, items).collect()) == [(k, k) for k in range(9)]


def test_repeated_windows_are_worked_off_in_runs(monkeypatch):
    from graphloom.llm import leaks

    items = [(i, "one two three four five six " * 4 + f"item{i}") for i in range(7)]
    text = "one two three four five six " * 9
    whole = leaks.ItemIndex(items, 5)
    want = sorted(whole.tile(whole.encode(text)))
    monkeypatch.setattr(leaks, "HITS", 10)
    assert len(list(whole.hits(whole.encode(text)))) == 7 and sorted(whole.tile(whole.encode(text))) == want and len(want) == 7
