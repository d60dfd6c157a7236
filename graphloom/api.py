"""One object with the verbs a user of a code graph calls; each gives a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import graph as G
from graphloom.operators import text as X
from graphloom.plans import context as P


class Graph:
    """A stored graph: a folder of nodes, edges, files, unresolved_refs and sdk_nodes tables."""

    def __init__(self, spark: SparkSession, folder: str, source: str = "both"):
        if source not in ("both", "project", "sdk"):
            raise ValueError("source must be both, project or sdk")
        self.spark, self.folder, self.source = spark, folder, source

    @cached_property
    def nodes(self) -> DataFrame:
        own = catalog.nodes(self.spark, self.folder)
        other = catalog.sdk_nodes(self.spark, self.folder)
        if self.source == "project":
            return own
        if self.source == "sdk":
            return other
        return own.unionByName(other.join(own.select("id"), "id", "left_anti"), allowMissingColumns=True)

    @cached_property
    def edges(self) -> DataFrame:
        return catalog.edges(self.spark, self.folder)

    @cached_property
    def files(self) -> DataFrame:
        return catalog.files(self.spark, self.folder)

    def symbols(self, name: str) -> DataFrame:
        """Symbols of a name, or of a qualified name's end; generated files last."""
        exact = self.nodes.where(F.lower("name") == name.lower())
        tail = self.nodes.where(F.col("qualified_name").endswith("::" + name) | F.col("qualified_name").endswith("." + name))
        return exact.unionByName(tail).dropDuplicates(["id"])

    def search(self, query: str, limit: int = 10) -> DataFrame:
        attached = catalog.sdk_nodes(self.spark, self.folder) if self.source == "both" else None
        return X.search(catalog.nodes(self.spark, self.folder), query, max(1, min(limit, 100)), attached=attached)

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return G.callers(self.edges, self.symbols(name), depth)

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return G.callees(self.edges, self.symbols(name), depth)

    def impact(self, name: str, depth: int = 2) -> DataFrame:
        return G.impact(self.edges, self.nodes, self.symbols(name), max(1, min(depth, 10)))

    def path(self, source: str, target: str) -> DataFrame:
        a = self.symbols(source).select(F.col("id").alias("source"))
        b = self.symbols(target).select(F.col("id").alias("target"))
        return G.shortest_paths(self.edges, a.crossJoin(F.broadcast(b)))

    def hierarchy(self, name: str) -> DataFrame:
        return G.type_hierarchy(self.edges, self.symbols(name))

    def explore(self, question: str) -> tuple[DataFrame, DataFrame]:
        return P.context(self.nodes, self.edges, question)

    def diff_impact(self, ranges: DataFrame, depth: int = 2) -> DataFrame:
        return P.diff_impact(self.nodes, self.edges, ranges, max(1, min(depth, 5)))

    def affected(self, changed: DataFrame, depth: int = 5) -> DataFrame:
        return G.affected_tests(G.file_dependencies(self.nodes, self.edges), changed, depth)

    def listing(self, prefix: str = "", glob: str | None = None) -> DataFrame:
        files = self.files.where(F.col("path").startswith(prefix))
        return G.file_glob(files, glob) if glob else files

    def dead_code(self) -> DataFrame:
        return G.dead_code(self.nodes, self.edges)

    def cycles(self) -> DataFrame:
        links = G.file_dependencies(self.nodes, self.edges)
        return G.cycles(links.select(F.col("file_path").alias("src"), F.col("depends_on").alias("dst")))
