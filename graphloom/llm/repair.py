"""Re-Pair grammars over token sequences: pairs that recur become rules, round by round.

One sequence is worked on as a list of strings.  A table's sequences are worked on
as 64-bit symbols in whole Arrow batches: a token's symbol is its hash, a rule's
symbol is made of those of its two sides, so tasks agree on symbols without a
shared dictionary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import staged

#: Joins the two sides of a rule's name; cannot occur in a token.
SEP = "\x1f"
#: Rounds after which the shortened sequences are written down again.
STAGE_EVERY = 4


def replace(sequence: list[str], rules: set[tuple[str, str]]) -> list[str]:
    """Left to right, each adjacent pair that is a rule becomes one symbol."""
    if rules.isdisjoint(zip(sequence, sequence[1:])):
        return sequence
    out: list[str] = []
    i, n = 0, len(sequence)
    while i < n:
        if i + 1 < n and (sequence[i], sequence[i + 1]) in rules:
            out.append(sequence[i] + SEP + sequence[i + 1])
            i += 2
        else:
            out.append(sequence[i])
            i += 1
    return out


def pairs_of(sequence: list[str]) -> list[tuple[str, str]]:
    """Adjacent pairs; in a run of one symbol overlapping pairs count once."""
    pairs = list(zip(sequence, sequence[1:]))
    if not any(a == b for a, b in pairs):
        return pairs
    found, last = [], None
    for pair in pairs:
        if pair == last and pair[0] == pair[1]:
            last = None
            continue
        found.append(pair)
        last = pair
    return found


def derive(sequence: list[str], rounds: list[set[tuple[str, str]]]) -> tuple[list[str], set[str]]:
    """The sequence under a grammar, and the names of all rules its derivation uses."""
    used: set[str] = set()
    for rules in rounds:
        shorter = replace(sequence, rules)
        if shorter is not sequence:
            used.update(s for s in shorter if SEP in s)
            sequence = shorter
    return sequence, used


def infer(sequence: list[str]) -> tuple[list[str], Counter]:
    """Re-Pair of one sequence: what is left, and how often each rule was used.

    Each round replaces every pair that occurs twice or more, the commonest
    first where pairs overlap, until none does; a round is linear and shortens the
    sequence, so it ends.
    """
    uses: Counter = Counter()
    while True:
        counts = Counter(pairs_of(sequence))
        taken: set[str] = set()
        rules = set()
        for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            if a in taken or b in taken:
                continue
            rules.add((a, b))
            taken.update((a, b))
        if not rules:
            return sequence, uses
        sequence = replace(sequence, rules)
        uses.update(s for s in sequence if SEP in s and s not in taken)


def admit(counted: list[tuple]) -> set[tuple]:
    """The rules of a round: of counted pairs, the commonest first, all that do not conflict.

    Two pairs conflict if one starts with what the other ends with, as both could
    claim the same symbol; the rarer one waits for the next round.
    """
    rules: set[tuple] = set()
    left: set = set()
    right: set = set()
    for a, b, _n in sorted(counted, key=lambda x: (-x[2], x[0], x[1])):
        if a in right or b in left:
            continue
        rules.add((a, b))
        left.add(a)
        right.add(b)
    return rules


# ---- tables of sequences -------------------------------------------------------------------------------------------


@lru_cache(maxsize=500_000)
def token_symbol(token: str) -> int:
    """The 64-bit symbol of a token, signed as tables hold it."""
    h = xxhash.xxh64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def join_symbols(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The symbols of the rules a b."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    h = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def rule_symbol(a: int, b: int) -> int:
    return int(join_symbols(np.array([a], np.int64), np.array([b], np.int64))[0])


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row of each symbol) of a list column."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), lengths)


def _pairs(symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places that start a pair, symbols of these pairs); of a run of one symbol every second pair."""
    at = np.flatnonzero(row[:-1] == row[1:])
    twin = np.flatnonzero(symbols[at] == symbols[at + 1])
    if len(twin):
        place = at[twin]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (np.diff(place) != 1) | (symbols[place[1:]] != symbols[place[:-1]])
        start = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
        at = np.delete(at, twin[(place - start) % 2 == 1])
    return at, join_symbols(symbols[at], symbols[at + 1])


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    found = np.searchsorted(ordered, values)
    found[found == len(ordered)] = 0
    return ordered[found] == values


def shorten(symbols: np.ndarray, row: np.ndarray, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rows) with each pair that is a rule (ordered symbols) replaced, and (row, rule) of each replacement."""
    at, pair = _pairs(symbols, row)
    hit = _is_in(pair, rules)
    at, pair = at[hit], pair[hit]
    if len(at):  # where rules overlap the first one from the left wins
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) != 1
        first = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        hit = (at - first) % 2 == 0
        at, pair = at[hit], pair[hit]
    out = symbols.copy()
    out[at] = pair
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return out[keep], row[keep], row[at], pair


def derivation(symbols: np.ndarray, row: np.ndarray, grammar: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, rule) of every rule used when the sequences are derived, each once per row, in row order."""
    rows, rules = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for level in grammar:
        symbols, row, r, used = shorten(symbols, row, level)
        rows.append(r)
        rules.append(used)
    row, rule = np.concatenate(rows), np.concatenate(rules)
    order = np.lexsort((rule, row))
    row, rule = row[order], rule[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(rule) != 0)
    return row[new], rule[new]


def _ordered(rules) -> np.ndarray:
    pairs = np.array(sorted(rules), np.int64).reshape(-1, 2)
    return np.sort(join_symbols(pairs[:, 0], pairs[:, 1]))


def infer_symbol_rules(df: DataFrame, column: str, seeds: list[set[tuple[int, int]]] = (), rounds: int | None = None, least: int = 16) -> list[set[tuple[int, int]]]:
    """A grammar over all symbol sequences (array<long>) of ``df``: the ``seeds``, then per round all pairs with
    ``least`` uses that do not conflict, until none is left.

    Pairs are counted over every row in the map tasks and summed by pair; only
    pairs with ``least`` uses reach the driver, which holds the grammar: at most a
    rule for every ``least`` tokens, the same for a table of any size.  ``rounds``
    ends it earlier.
    """
    spark = df.sparkSession
    rows = df.select(F.col(column).alias("s")).where(F.size("s") > 1)
    grammar, pending, inferred = [set(s) for s in seeds], [_ordered(s) for s in seeds], 0

    def shortened(column: pa.Array, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        symbols, row = sequences(column)
        for level in levels:
            symbols, row, _, _ = shorten(symbols, row, level)
        return symbols, row

    while rounds is None or inferred < rounds:
        shared = spark.sparkContext.broadcast(pending)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []

            def flush() -> pa.RecordBatch:
                a, b, n = map(np.concatenate, zip(*held)) if held else (np.empty(0, np.int64),) * 3
                held.clear()
                _, first, to = np.unique(join_symbols(a, b), return_index=True, return_inverse=True)
                total = np.bincount(to, weights=n, minlength=len(first)).astype(np.int64)
                held.append((a[first], b[first], total))
                return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b", "n"])

            size = 0
            for batch in batches:
                symbols, row = shortened(batch.column(0), shared.value)
                at, pair = _pairs(symbols, row)
                _, first, n = np.unique(pair, return_index=True, return_counts=True)
                held.append((symbols[at[first]], symbols[at[first] + 1], n))
                size += len(first)
                if size > 2_000_000:  # bounds the memory of a task
                    yield flush()
                    held.clear()
                    size = 0
            yield flush()

        pairs = rows.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        rules = admit([tuple(r) for r in pairs.collect()])
        if not rules:
            break
        grammar.append(rules)
        inferred += 1
        pending = [*pending, _ordered(rules)]
        if len(pending) >= STAGE_EVERY:
            shared = spark.sparkContext.broadcast(pending)

            def rewrite(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    symbols, row = shortened(batch.column(0), shared.value)
                    sizes = np.bincount(row, minlength=batch.num_rows)
                    keep = sizes > 1  # one symbol alone has no pair any more
                    offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(symbols[keep[row]]))], names=["s"])

            rows = staged(rows.mapInArrow(rewrite, "s array<long>"), "sequences")
            pending = []
    return grammar


def ordered_levels(grammar: list[set[tuple[int, int]]]) -> list[np.ndarray]:
    """The levels of a symbol grammar in the form that ``derivation`` takes."""
    return [_ordered(level) for level in grammar]


def symbol_sequences(df: DataFrame, tokens: str, out: str = "s") -> DataFrame:
    """(out): the token arrays of ``df`` as arrays of symbols; null arrays are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = [[token_symbol(t) for t in s] for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.list_(pa.int64()))], names=[out])

    return df.select(tokens).where(F.col(tokens).isNotNull()).mapInArrow(run, f"{out} array<long>")


def infer_rules(df: DataFrame, tokens: str, rounds: int | None = None, least: int = 16) -> list[set[tuple[str, str]]]:
    """The grammar of ``infer_symbol_rules`` over token arrays, with rules spelled out as tokens."""
    rows = staged(symbol_sequences(df, tokens), "sequences")
    grammar = infer_symbol_rules(rows, "s", (), rounds, least)
    made = {rule_symbol(a, b) for level in grammar for a, b in level}
    ends = {x for level in grammar for pair in level for x in pair} - made
    if not ends:
        return []

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t for t in batch.column(0).to_pylist() if token_symbol(t) in ends]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["token"])

    words = df.select(F.explode(tokens).alias("token")).where("token is not null").distinct().mapInArrow(spell, "token string")
    names = {token_symbol(r[0]): r[0] for r in words.collect()}  # at most two tokens a rule
    out = []
    for level in grammar:
        out.append({(names[a], names[b]) for a, b in level})
        names |= {rule_symbol(a, b): names[a] + SEP + names[b] for a, b in level}
    return out
