"""The graph of specifications, commits and code fragments."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of the five factors of a trace.
TRACE = {"path": 0.30, "content": 0.25, "name": 0.15, "recency": 0.20, "overlap": 0.10}


@dataclass(frozen=True)
class SpecGraph:
    """specs (id, title, status, version, file_path, ts_ms), commits (hash, message, ts_ms), fragments (id, change_type, file_path, start_line, end_line),
    spec_commit (spec_id, commit_hash, relation_type), commit_fragment (commit_hash, fragment_id), spec_spec (spec_id, other_id, relation_type)."""

    specs: DataFrame
    commits: DataFrame
    fragments: DataFrame
    spec_commit: DataFrame
    commit_fragment: DataFrame
    spec_spec: DataFrame

    def chain(self, active: bool = True) -> DataFrame:
        """specs to fragments over commits, one row per path."""
        specs = self.specs.where("status = 'active'") if active else self.specs
        f = self.fragments.select(F.col("id").alias("fragment_id"), F.col("file_path").alias("f_path"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
        return (
            specs.withColumnRenamed("id", "spec_id").join(self.spec_commit, "spec_id").join(self.commit_fragment, "commit_hash").join(f, "fragment_id")
        )

    def specs_of_file(self, path: str, most: int = 50) -> tuple[DataFrame, bool]:
        """(specs whose fragments lie in the path, whether there were more than ``most``); an empty path is an error."""
        if not path:
            raise ValueError("path must not be empty")
        hit = self.chain().where(F.col("f_path").contains(path)).select("spec_id", "title", "ts_ms").distinct()
        more = hit.orderBy(F.desc("ts_ms"), "spec_id").limit(most + 1)
        truncated = more.count() > most
        return more.orderBy(F.desc("ts_ms"), "spec_id").limit(most), truncated

    def candidates(self, path: str, start: int, end: int, most: int | None = 100) -> DataFrame:
        """Active specs with fragments in the path: fragments, commits, best level of path match and the overlap there."""
        level = F.when(F.col("f_path") == path, 3).when(F.col("f_path").endswith(path), 2).otherwise(1)
        overlap = F.greatest(F.least("f_end", F.lit(end)) - F.greatest("f_start", F.lit(start)) + 1, F.lit(0))
        hit = self.chain().where(F.col("f_path").contains(path)).withColumns({"level": level, "overlap": overlap})
        out = hit.groupBy("spec_id", "title", "ts_ms").agg(
            F.countDistinct("fragment_id").alias("n_fragments"), F.countDistinct("commit_hash").alias("n_commits"), F.max("level").alias("path_level"),
            F.max_by("overlap", F.struct("level", "overlap")).alias("overlap_lines"),
        )
        return out.orderBy(F.desc("ts_ms"), "spec_id").limit(most) if most else out

    def trace(self, path: str, start: int, end: int, name: str, now_ms: int, most: int = 100) -> DataFrame:
        """Candidates with the five factors and their weighted sum; content and name look for the symbol's name in messages and titles."""
        found = self.candidates(path, start, end, most)
        low = name.lower()
        told = self.spec_commit.join(self.commits.where(F.lower("message").contains(low)), F.col("commit_hash") == F.col("hash")).select(F.col("spec_id").alias("t_id")).distinct()
        days = F.greatest((F.lit(now_ms) - F.col("ts_ms")) / 86_400_000, F.lit(0.0))
        scored = (
            found.join(told.withColumn("told", F.lit(1.0)), F.col("spec_id") == F.col("t_id"), "left").drop("t_id")
            .withColumn("path", F.when(F.col("path_level") == 3, 1.0).when(F.col("path_level") == 2, 0.8).otherwise(0.6))
            .withColumn("content", F.coalesce("told", F.lit(0.0)))
            .withColumn("name", F.lower("title").contains(low).cast("double"))
            .withColumn("recency", 1 / (1 + days / 180))
            .withColumn("overlap", F.least(F.lit(1.0), F.col("overlap_lines") / max(1, end - start + 1)))
        )
        score = sum((F.col(k) * w for k, w in TRACE.items()), F.lit(0.0))
        return scored.withColumn("score", score).drop("told")

    def context(self, per_spec: int = 5) -> DataFrame:
        """Each spec with its first commits: generating ones before others, newer before older."""
        c = self.spec_commit.join(self.commits, F.col("commit_hash") == F.col("hash"))
        order = Window.partitionBy("spec_id").orderBy(F.when(F.col("relation_type") == "GENERATE", 0).otherwise(1), F.desc("ts_ms"), "commit_hash")
        return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_spec).select("spec_id", "commit_hash", "relation_type", "rank")

    def affected_by(self, paths: DataFrame) -> DataFrame:
        """(spec_id): active specs with a fragment whose path lies in a changed path, or the other way round: one holds the other.

        A changed folder, or any run of a path's characters, counts.  The shorter of two
        paths that hold each other is a run of its own length in the longer one, so
        both sides meet by equal runs of the lengths that the other side has; lengths
        are few, and every path is laid out once per length.
        """
        changed = paths.select(F.col("path").alias("c_path")).where("c_path is not null and c_path <> ''").distinct()
        mine = self.chain().select("spec_id", F.col("f_path")).where("f_path is not null and f_path <> ''").distinct()
        own = mine.select("f_path").distinct()

        def runs(df: DataFrame, path: str, other: DataFrame, short: str) -> DataFrame:
            """(path, short): the paths of ``other`` that a path holds."""
            lengths = other.select(F.length(short).alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))  # at most one row per length of a path
            laid = df.crossJoin(F.broadcast(lengths)).select(path, F.explode("lengths").alias("n")).where(F.col("n") <= F.length(path))
            at = laid.select(path, "n", F.explode(F.sequence(F.lit(1), F.length(path) - F.col("n") + 1)).alias("i"))
            return at.select(path, F.substring(F.col(path), F.col("i"), F.col("n")).alias(short)).distinct().join(other, short)

        met = runs(own, "f_path", changed, "c_path").select("f_path").unionByName(runs(changed, "c_path", own, "f_path").select("f_path")).distinct()
        return mine.join(met, "f_path", "left_semi").select("spec_id").distinct()

    def new_version(self, ids: DataFrame) -> SpecGraph:
        """The given specs (id) one version on, under id@version, the old ones deprecated and linked by EVOLVED_FROM; relations move along."""
        keys = ids.select(F.col("id").alias("k")).distinct()
        hit = self.specs.join(keys, F.col("id") == F.col("k"), "left_semi")
        name = F.concat("id", F.lit("@"), (F.col("version") + 1).cast("string"))
        fresh = hit.withColumn("old_id", F.col("id")).withColumn("id", name).withColumn("version", F.col("version") + 1)
        mark = keys.withColumn("gone", F.lit(True))
        old = self.specs.join(mark, F.col("id") == F.col("k"), "left").withColumn("status", F.when(F.col("gone"), "deprecated").otherwise(F.col("status"))).select(*self.specs.columns)
        names = fresh.select(F.col("old_id").alias("o"), F.col("id").alias("n"))
        moved = self.spec_commit.join(names, F.col("spec_id") == F.col("o"), "left").withColumn("spec_id", F.coalesce("n", "spec_id")).select(*self.spec_commit.columns).distinct()
        evolved = names.select(F.col("n").alias("spec_id"), F.col("o").alias("other_id"), F.lit("EVOLVED_FROM").alias("relation_type"))
        return replace(self, specs=old.unionByName(fresh.select(*self.specs.columns)), spec_commit=moved, spec_spec=self.spec_spec.unionByName(evolved))

    def stats(self) -> DataFrame:
        """Counts of specs by status, commits, fragments and relations."""
        parts = [self.specs.groupBy(F.concat(F.lit("specs_"), "status").alias("metric")).agg(F.count(F.lit(1)).alias("value"))]
        for metric, df in (("commits", self.commits), ("fragments", self.fragments), ("spec_commit", self.spec_commit), ("commit_fragment", self.commit_fragment), ("spec_spec", self.spec_spec)):
            parts.append(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
