"""A Python data source over a local git repository: spark.read.format("gitcommits").load(path)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Range(InputPartition):
    def __init__(self, skip: int, count: int):
        self.skip, self.count = skip, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options.get("path", "."), int(options.get("commitsPerPartition", "5000"))

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.path, *args], capture_output=True, text=True, check=True).stdout

    def partitions(self) -> list[InputPartition]:
        n = int(self._git("rev-list", "--count", "HEAD").strip() or 0)
        return [_Range(k, self.size) for k in range(0, n, self.size)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.count:
            return
        out = self._git("log", f"--skip={partition.skip}", f"--max-count={partition.count}", "--format=%H%x1f%an%x1f%ct%x1f%B%x00")
        for row in out.split("\0"):
            if row.strip():
                commit, author, seconds, message = row.lstrip("\n").split("\x1f", 3)
                yield commit, author, int(seconds) * 1000, message.rstrip()


class GitCommits(DataSource):
    """(hash, author, ts_ms, message) of the commits reachable from HEAD, read in ranges."""

    @classmethod
    def name(cls) -> str:
        return "gitcommits"

    def schema(self) -> str:
        return "hash string, author string, ts_ms long, message string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
