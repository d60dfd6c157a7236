"""A graph in numbers, small enough for the memory of every task that searches it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.many import spelled
from graphloom.runtime import staged

#: Links, roots, bytes of ids and nodes of a graph that is sent to the tasks; about 4 bytes a link there, 12 in the driver.
LINKS, ROOTS, ID_BYTES, NODES = 16_000_000, 1_000_000, 208 << 20, 1 << 23
#: Links that the driver collects at a time.
SLICE = 2_000_000
#: Pairs that a task sorts by target before it hands them on, roots they may come from, and pairs handed on in a row.
HELD, HELD_ROOTS, ROW = 12_000_000, 1 << 16, 1 << 16


class Graph:
    """Nodes numbered in the order of their ids; the links of each node in that order."""

    def __init__(self, ids: pa.Array, hashes: np.ndarray, links: Iterator[pa.Table], count: int):
        """``ids`` in order, ``links`` as hashes; links with an end that is not among the ids are left out."""
        self.ids = ids
        self._number = np.argsort(hashes).astype(np.int32)
        self._hashes = hashes[self._number]
        link, done = np.empty(count, np.int64), 0
        for batch in (b for table in links for b in table.to_batches(500_000)):  # bounds what the driver holds
            source, target = (self.number(batch.column(i).to_numpy()) for i in (0, 1))
            there = (source >= 0) & (target >= 0)
            size = int(there.sum())
            link[done : done + size] = source[there] * np.int64(len(ids)) + target[there]
            done += size
        link = link[:done]
        link.sort()
        kept, last = 0, -1
        for a in range(0, done, 500_000):  # each link once, where it lies
            part = link[a : a + 500_000]
            part = part[np.diff(part, prepend=last) != 0]
            link[kept : kept + len(part)] = part
            kept, last = kept + len(part), link[kept + len(part) - 1] if len(part) else last
        link = link[:kept]
        self.offsets = np.searchsorted(link, np.arange(len(ids) + 1) * np.int64(len(ids))).astype(np.int32)
        self.to = np.empty(kept, np.int32)
        for a in range(0, kept, 500_000):
            self.to[a : a + 500_000] = link[a : a + 500_000] % len(ids)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each node, -1 if there is none."""
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        return np.where(self._hashes[at] == hashes, self._number[at].astype(np.int64), -1)

    def levels(self, root: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, place of each one's parent in the level before) per level, both in the order of their least paths."""
        n = len(self.offsets) - 1
        seen, place = np.zeros(n, bool), np.empty(n, np.int64)
        level, parent, depth = np.array([root]), np.array([0]), 0
        while len(level):
            seen[level] = True
            yield level, parent
            if depth == most:
                return
            depth += 1
            parent, to = spelled(level, self.offsets, self.to)
            parent, to = parent[~seen[to]], to[~seen[to]]
            count = np.arange(len(to))
            place[to[::-1]] = count[::-1]  # the first use of a node stays
            first = place[to] == count
            level, parent = to[first], parent[first]

    def reached(self, root: int, most: int | None) -> Iterator[np.ndarray]:
        """The nodes of each level, in order."""
        n = len(self.offsets) - 1
        seen, level, depth = np.zeros(n, bool), np.array([root]), 0
        while len(level):
            seen[level] = True
            yield level
            if depth == most:
                return
            depth += 1
            first, count = self.offsets[level], self.offsets[level + 1] - self.offsets[level]
            at = np.repeat(first + count - np.cumsum(count, dtype=np.int32), count)
            at += np.arange(len(at), dtype=np.int32)
            to = self.to[at]
            to = to[~seen[to]]
            if len(to) < n >> 5:
                level = np.unique(to)
            else:
                fresh = np.zeros(n, bool)
                fresh[to] = True
                level = np.flatnonzero(fresh)


def _column(df: DataFrame, name: str) -> np.ndarray:
    return df.select(F.xxhash64(name).alias("h")).toArrow().column("h").to_numpy()


def compact(links: DataFrame, roots: DataFrame, known: DataFrame | None = None) -> Graph | None:
    """The graph of ``links`` (src, dst) between ``known`` ids (id; all by default) and of ``roots`` (root), or None if it is empty, too large or two ids have one hash."""
    pairs = staged(links.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d")), "pairs")
    if (count := pairs.count()) > LINKS or roots.count() > ROOTS:
        return None
    yes, no = F.lit(True), F.lit(False)
    rows = links.select(F.explode(F.array("src", "dst")).alias("id"), yes.alias("end"), F.lit(known is None).alias("known"))
    rows = rows.unionByName(roots.select(F.col("root").alias("id"), yes.alias("end"), yes.alias("known")))
    if known is not None:
        rows = rows.unionByName(known.select("id", no.alias("end"), yes.alias("known")))
    ids = rows.groupBy("id").agg(F.max("end").alias("end"), F.max("known").alias("known")).where("end").select("id", "known", F.xxhash64("id").alias("h"))
    ids = staged(ids, "ids")
    if (ids.where("known").agg(F.sum(F.length(F.col("id").cast("string")) + 8)).first()[0] or 0) > ID_BYTES:
        return None
    strays = ids.where("not known").select("h")  # their links are told by their hashes
    if strays.count() > LINKS >> 1:
        return None
    named = ids.where("known").select("id", "h").toArrow()
    named = named.take(pc.sort_indices(named, [("id", "ascending")]))
    hashes = named.column("h").to_numpy()
    every = np.concatenate([hashes, strays.toArrow().column("h").to_numpy()])
    every.sort()
    if not 0 < len(hashes) <= NODES or (every[1:] == every[:-1]).any():
        return None
    del every
    column = named.column("id").combine_chunks()
    del named
    pa.default_memory_pool().release_unused()
    slices = -(-count // SLICE)
    return Graph(column, hashes, (pairs.where(F.pmod(F.col("d"), F.lit(slices)) == i).toArrow() for i in range(slices)), count)


def search_compact(graph: Graph, starts: DataFrame, ends: DataFrame, most: int | None, paths: bool) -> DataFrame:
    """See ``graph.shortest_paths``: ``ends`` has p_target, and p_source where each source has targets of its own."""
    spark, kind = starts.sparkSession, starts.schema["root"].dataType
    n, roots = len(graph.ids), graph.number(_column(starts, "root"))
    wanted, own = np.zeros(n, bool), None
    if "p_source" in ends.columns:
        both = ends.select(F.xxhash64("p_source").alias("s"), F.xxhash64("p_target").alias("t")).toArrow()
        source, target = graph.number(both.column("s").to_numpy()), graph.number(both.column("t").to_numpy())
        there = (source >= 0) & (target >= 0)
        own = np.unique(source[there] * max(1, n) + target[there])
        wanted[own % n] = True
    else:
        numbers = graph.number(_column(ends, "p_target"))
        wanted[numbers[numbers >= 0]] = True
    # Without paths only roots and targets are named in the tasks.
    named = wanted.copy()
    named[roots] = True
    place = np.arange(n) if paths else (np.cumsum(named) - 1).astype(np.int32)
    graph.ids, graph._number, graph._hashes = graph.ids if paths else graph.ids.filter(pa.array(named)), None, None
    shared = spark.sparkContext.broadcast((graph, place, roots, wanted, own))

    def asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Each root, and which nodes are asked for from there."""
        _, _, roots, wanted, own = shared.value
        for batch in batches:
            for root in roots[batch.column(0).to_numpy()].tolist():
                asked = wanted
                if own is not None:
                    asked = np.zeros(n, bool)
                    asked[own[np.searchsorted(own, root * n) : np.searchsorted(own, (root + 1) * n)] % n] = True
                yield root, asked

    def with_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value[0]
        ids = graph.ids

        def told(root: int, held: list[tuple]) -> pa.RecordBatch:
            target = np.concatenate([x[0] for x in held])
            hops = np.repeat(np.array([x[1] for x in held], np.int32), [len(x[0]) for x in held])
            offsets = pa.array(np.concatenate([[0], np.cumsum(hops + 1)]).astype(np.int32))
            path = pa.ListArray.from_arrays(offsets, ids.take(pa.array(np.concatenate([x[2].ravel() for x in held]))))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(target), root))), ids.take(pa.array(target)), path, pa.array(hops)], names=["source", "target", "path", "hops"])

        for root, asked in asked_of(batches):
            held, size, way = [], 0, np.empty((1, 0), np.int64)
            for hops, (level, parent) in enumerate(graph.levels(root, most)):
                way, hit = np.column_stack([way[parent], level]), asked[level]
                held.append((level[hit], hops, way[hit]))
                size += int(hit.sum()) * (hops + 1)
                if size > 200_000:
                    yield told(root, held)
                    held, size = [], 0
            if size:
                yield told(root, held)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs as numbers, by target: (names of sources, of targets, and hops, place of source and of target in one number)."""
        graph, place, _, wanted, _ = shared.value
        held, size, sources = np.empty(max(HELD, int(wanted.sum())), np.int64), 0, []

        def names(numbers: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), graph.ids.take(pa.array(place[numbers])))

        def told() -> Iterator[pa.RecordBatch]:
            held[:size].sort()
            for a in range(0, size, ROW):
                key = held[a : min(a + ROW, size)]
                target, root, hops = key >> 39, key >> 23 & 0xFFFF, key & (1 << 23) - 1
                new = np.diff(target, prepend=-1) != 0
                there = np.zeros(len(sources), bool)
                there[root] = True
                code = hops << 32 | (np.cumsum(there) - 1)[root] << 16 | np.cumsum(new) - 1
                codes = pa.ListArray.from_arrays(pa.array([0, len(code)], pa.int32()), pa.array(code))
                yield pa.RecordBatch.from_arrays([names(np.array(sources)[there]), names(target[new]), codes], names=["sources", "targets", "codes"])

        for root, asked in asked_of(batches):
            hits = [(level[asked[level]].astype(np.int64) << 39) + hops for hops, level in enumerate(graph.reached(root, most))]
            count = sum(map(len, hits))
            if size + count > len(held) or len(sources) == HELD_ROOTS:
                yield from told()
                size, sources = 0, []
            if count:
                np.concatenate(hits, out=held[size : size + count])
                held[size : size + count] += len(sources) << 23
                size += count
                sources.append(root)
        yield from told()

    rows = spark.range(0, len(roots), 1, max(1, min(len(roots), 4 * spark.sparkContext.defaultParallelism)))
    if paths:
        return rows.mapInArrow(with_paths, T.StructType([T.StructField("source", kind), T.StructField("target", kind), T.StructField("path", T.ArrayType(kind)), T.StructField("hops", T.IntegerType())]))
    pairs = rows.mapInArrow(without, T.StructType([T.StructField("sources", T.ArrayType(kind)), T.StructField("targets", T.ArrayType(kind)), T.StructField("codes", T.ArrayType(T.LongType()))]))
    pairs, code = pairs.select("sources", "targets", F.explode("codes").alias("code")), F.col("code")
    source, target = F.shiftright(code, 16).bitwiseAND(0xFFFF).cast("int"), code.bitwiseAND(0xFFFF).cast("int")
    return pairs.select(F.get("sources", source).alias("source"), F.get("targets", target).alias("target"), F.shiftright(code, 32).cast("int").alias("hops"))
