"""Evaluation items inside a text collection (problem 6): greedy string tiling.

Words are compared by their looks (problem 8) without case.  The items of a
block become a Karp-Rabin index of all their word windows; each document's
windows are looked up in it, hits on one diagonal grow to longest matches, and
these are marked from the longest down without overlap.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.lookalike import skeleton

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of items that one block holds; a larger item set takes several passes over the documents.
BLOCK_CHARS = 32_000_000
#: Shared windows of a document that are held at once, give or take those of one item.
HITS = 4_000_000


def words(text: str) -> list[str]:
    """Runs of letters and digits, as they look, without case."""
    return _WORD.findall(skeleton(text).lower())


class ItemIndex:
    """All windows of ``width`` words of a block of items, by rolling hash."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, self.vocabulary = width, {}
        self.ids, self.words = [], []
        hashes, owners, places = [], [], []
        vocabulary = self.vocabulary
        for key, text in items:
            codes = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text or "")], np.int64)
            if len(codes) < width:
                continue
            h = self._roll(codes)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.ids)))
            places.append(np.arange(len(h)))
            self.ids.append(key)
            self.words.append(codes)
        if hashes:
            h, o, p = map(np.concatenate, (hashes, owners, places))
            order = np.argsort(h, kind="stable")
            h, self.owner, self.place = h[order], o[order], p[order]
            self.keys, self.start = np.unique(h, return_index=True)
            self.stop = np.append(self.start[1:], len(h))
        else:
            self.keys = np.empty(0, np.uint64)

    def _roll(self, codes: np.ndarray) -> np.ndarray:
        """Karp-Rabin hashes of all windows: Horner's rule, one multiplication per word of the width."""
        n = len(codes) - self.width + 1
        c = codes.astype(np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(self.width):
            h = h * _BASE + c[k : k + n]
        return h ^ (h >> np.uint64(29))

    def encode(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place in item, place in document) of the shared windows, some items at a time.

        A window that many items and many places of the document repeat meets all of
        them; items are taken in runs so that no more than HITS of these are held.
        """
        if len(codes) < self.width or not len(self.keys):
            return
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        at = np.flatnonzero(unknown[self.width :] == unknown[: -self.width])
        if not len(at):
            return
        h = self._roll(codes)[at]
        found = np.searchsorted(self.keys, h)
        found[found == len(self.keys)] = 0
        ok = self.keys[found] == h
        at, found = at[ok], found[ok]
        if not len(at):
            return
        # Windows of one hash are stored by item: a run of items is a slice of each window's places.
        each, times = np.unique(found, return_counts=True)
        per_item = np.zeros(len(self.ids), np.int64)
        for w, t in zip(each, times):
            np.add.at(per_item, self.owner[self.start[w] : self.stop[w]], t)
        runs = np.cumsum(per_item) // HITS
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        for run in np.unique(runs[per_item > 0]):
            lo, hi = np.flatnonzero(runs == run)[[0, -1]]
            first = {w: (self.start[w] + np.searchsorted(self.owner[self.start[w] : self.stop[w]], lo), self.start[w] + np.searchsorted(self.owner[self.start[w] : self.stop[w]], hi, "right")) for w in each}
            begin, end = (np.array([first[w][k] for w in each]) for k in (0, 1))
            where = np.searchsorted(each, found)
            n = (end - begin)[where]
            if n.sum():
                rows = np.repeat(begin[where] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield self.owner[rows], self.place[rows], np.repeat(at, n)

    def tile(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, longest tile, tiles, covered words, words of the item) for each item that shares a window."""
        for item, place, at in self.hits(codes):
            yield from self._tile(codes, item, place, at)

    def _tile(self, codes: np.ndarray, item: np.ndarray, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        diagonal = at - place
        order = np.lexsort((at, diagonal, item))
        item, place, at, diagonal = item[order], place[order], at[order], diagonal[order]
        new = np.ones(len(item), bool)
        new[1:] = (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(item))) + self.width - 1
        for k in np.unique(item[first]):
            runs = np.flatnonzero(item[first] == k)
            theirs = self.words[k]
            heap = []
            for r in runs:
                a, b, n = int(at[first[r]]), int(place[first[r]]), int(length[r])
                same = codes[a : a + n] == theirs[b : b + n]  # equal hashes may hide different words
                for lo, hi in _stretches(same, self.width):
                    heapq.heappush(heap, (-(hi - lo), b + lo, a + lo))
            doc_mark, item_mark = {}, np.zeros(len(theirs), bool)
            longest = tiles = 0
            while heap:
                n, b, a = heapq.heappop(heap)
                n = -n
                free = ~item_mark[b : b + n]
                if doc_mark:
                    free &= np.array([(a + i) not in doc_mark for i in range(n)])
                if free.all():
                    item_mark[b : b + n] = True
                    doc_mark.update(dict.fromkeys(range(a, a + n)))
                    longest, tiles = max(longest, n), tiles + 1
                else:
                    for lo, hi in _stretches(free, self.width):
                        heapq.heappush(heap, (-(hi - lo), b + lo, a + lo))
            if tiles:
                yield int(k), longest, tiles, int(item_mark.sum()), len(theirs)


def _stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def _blocks(items: DataFrame, id_column: str, text: str) -> Iterator[list[tuple]]:
    sized = items.select(F.col(id_column), F.col(text)).where(F.col(id_column).isNotNull())
    total = sized.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for b in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64(id_column), F.lit(n)) == b)
        yield [tuple(r) for r in part.distinct().collect()]  # about BLOCK_CHARS characters, as counted above


def tile_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_match: int = 15,
) -> DataFrame:
    """(doc_id, item_id, longest, tiles, covered_words, coverage) for all documents that share
    ``min_match`` consecutive words with an item.

    Whole texts are tiled.  Null or empty texts share nothing; an item of fewer
    words is never matched; rows repeated under one id give repeated results only
    if the rows differ.  Result columns are long, long, int, int, int, double.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, longest int, tiles int, covered_words int, coverage double"
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("text is not null")
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(ItemIndex(block, min_match))  # built once; its size goes with BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k, longest, tiles, covered, n in index.tile(index.encode(text)):
                        rows.append((key, index.ids[k], longest, tiles, covered, covered / n))
                columns = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "longest", "tiles", "covered_words", "coverage"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
