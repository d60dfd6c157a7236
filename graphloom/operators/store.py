"""The property-graph store: identity, replacement and cascade rules as DataFrame functions.

A snapshot is a set of immutable tables; every change gives new DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ("source", "target", "kind", "line", "col")


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null key: greatest ``order``, nulls last, ties by the other columns.

    A map-side combinable maximum, so a key with very many rows is no burden.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.struct(F.col(order), *[F.col(c) for c in rest])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("__row"))
    return best.select(*[F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns])


def dedup_edges(edges: DataFrame, order: str = "id") -> DataFrame:
    """One row per edge identity (nulls of line and col are one value each): the one inserted first."""
    rest = [c for c in edges.columns if c not in (*IDENTITY, order)]
    first = edges.groupBy(*IDENTITY).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("__row"))
    return first.select(*[F.col(c) if c in IDENTITY else F.col(f"__row.{c}").alias(c) for c in edges.columns])


def drop_orphans(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends exist in ``ids`` (column id); null ends do not exist.

    Ends are made distinct first, in the map tasks, and only those that name nothing
    are joined back: they are few, so the join turns into a broadcast at run time and
    a target with a tenth of all edges never meets in one task.
    """
    keys = ids.select(F.col("id").alias("__id")).where("__id is not null").distinct()
    ends = edges.select(F.col("source").alias("__end")).distinct().unionByName(edges.select(F.col("target").alias("__end")).distinct()).distinct()
    missing = ends.where("__end is not null").join(keys, F.col("__end") == F.col("__id"), "left_anti")
    edges = edges.where("source is not null and target is not null")
    for end in ("source", "target"):
        edges = edges.join(missing, F.col(end) == F.col("__end"), "left_anti")
    return edges


@dataclass(frozen=True)
class Snapshot:
    """Tables of one graph: nodes (id ...), edges (IDENTITY ...), files (path ...), refs (id, from_node_id ...)."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    refs: DataFrame

    def upsert_nodes(self, rows: DataFrame) -> Snapshot:
        """Replace nodes by id; rows without id, kind, name, file_path or language are skipped; of equal ids the newest counts."""
        whole = rows.dropna(subset=["id", "kind", "name", "file_path", "language"])
        fresh = newest(whole, "id", "updated_at")
        kept = self.nodes.join(fresh.select("id"), "id", "left_anti")
        return replace(self, nodes=kept.unionByName(fresh))

    def insert_edges(self, rows: DataFrame) -> Snapshot:
        """Add edges with new identities and two existing ends; an identity that exists is ignored."""
        sound = drop_orphans(dedup_edges(rows), self.nodes)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDENTITY]
        new = sound.alias("a").join(self.edges.select(*IDENTITY).alias("b"), same, "left_anti")
        return replace(self, edges=self.edges.unionByName(new.select(*self.edges.columns)))

    def delete_nodes(self, ids: DataFrame) -> Snapshot:
        """Delete nodes by id, with their edges on either side and their unresolved references."""
        gone = ids.select(F.col("id").alias("__id")).where("__id is not null").distinct()
        edges = self.edges
        for end in ("source", "target"):
            edges = edges.join(gone, F.col(end) == F.col("__id"), "left_anti")
        return replace(
            self,
            nodes=self.nodes.join(gone, F.col("id") == F.col("__id"), "left_anti"),
            edges=edges,
            refs=self.refs.join(gone, F.col("from_node_id") == F.col("__id"), "left_anti"),
        )

    def delete_files(self, paths: DataFrame) -> Snapshot:
        """Delete files by path together with everything found in them."""
        gone = paths.select(F.col("path").alias("__path")).distinct()
        ids = self.nodes.join(gone, F.col("file_path") == F.col("__path"), "left_semi").select("id")
        less = self.delete_nodes(ids)
        return replace(less, files=less.files.join(gone, F.col("path") == F.col("__path"), "left_anti"))

    def delete_edges(self, condition: Column) -> Snapshot:
        return replace(self, edges=self.edges.where(~F.coalesce(condition, F.lit(False))))

    def upsert_files(self, rows: DataFrame) -> Snapshot:
        fresh = newest(rows, "path", "indexed_at")
        return replace(self, files=self.files.join(fresh.select("path"), "path", "left_anti").unionByName(fresh))

    def replace_files(self, nodes: DataFrame, edges: DataFrame, files: DataFrame) -> Snapshot:
        """New contents for the given files.

        Edges that other files had into the replaced ones move to the new node of
        the same (file, kind, name); where there is none they become pending references.
        """
        changed = files.select("path").distinct()
        old = self.nodes.join(changed, F.col("file_path") == F.col("path"), "left_semi")
        old_ids = old.select(F.col("id").alias("old_id"), *[F.col(c).alias(f"k_{c}") for c in ("file_path", "kind", "name")])
        source_file = self.nodes.select(F.col("id").alias("s_id"), F.col("file_path").alias("s_path"))
        incoming = (
            self.edges.where("kind <> 'contains'")
            .join(old_ids, F.col("target") == F.col("old_id"))
            .join(source_file, F.col("source") == F.col("s_id"))
            .join(changed, F.col("s_path") == F.col("path"), "left_anti")
        )
        keys = nodes.groupBy(*[F.col(c).alias(f"n_{c}") for c in ("file_path", "kind", "name")]).agg(F.min("id").alias("new_id"))
        match = [F.col(f"k_{c}") == F.col(f"n_{c}") for c in ("file_path", "kind", "name")]
        moved = incoming.join(keys, match, "left")
        again = moved.where("new_id is not null").select(*[F.col("new_id").alias("target") if c == "target" else F.col(c) for c in self.edges.columns])
        lost = moved.where("new_id is null").select(
            F.xxhash64("source", "target", "kind", F.coalesce("line", F.lit(-1))).alias("id"),
            F.col("source").alias("from_node_id"),
            F.col("k_name").alias("reference_name"),
            F.col("kind").alias("reference_kind"),
            "line",
            "col",
            F.col("s_path").alias("file_path"),
            F.lit("pending").alias("status"),
            F.col("k_name").alias("name_tail"),
        )
        base = self.delete_files(changed)
        base = replace(base, nodes=base.nodes.unionByName(nodes), files=base.files.unionByName(files))
        base = replace(base, refs=base.refs.unionByName(lost, allowMissingColumns=True))
        return base.insert_edges(edges.unionByName(again))


def hash_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified (other content_hash) or removed between two file tables."""
    a = before.select(F.col("path"), F.col("content_hash").alias("old_hash"), F.lit(1).alias("was"))
    b = after.select(F.col("path"), F.col("content_hash").alias("new_hash"), F.lit(1).alias("is"))
    joined = a.join(b, "path", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    )
    return joined.select("path", change.alias("change")).where("change is not null")


def definition_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, name, change): definitions that appeared or went away."""
    a = before.select("file_path", "name").distinct().withColumn("was", F.lit(1))
    b = after.select("file_path", "name").distinct().withColumn("is", F.lit(1))
    joined = a.join(b, ["file_path", "name"], "full_outer")
    return joined.select("file_path", "name", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").alias("change")).where("change is not null")


def retry_failed(refs: DataFrame, names: DataFrame, ceiling: int = 500) -> DataFrame:
    """Failed references whose name tail is now defined, unless more than ``ceiling`` failed references share it."""
    few = refs.where("status = 'failed'").groupBy("name_tail").count().where(F.col("count") <= ceiling).select("name_tail")
    defined = names.select(F.col("name").alias("name_tail")).distinct()
    return refs.where("status = 'failed'").join(few, "name_tail", "left_semi").join(defined, "name_tail", "left_semi")
