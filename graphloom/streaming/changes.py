"""File changes as a stream: quiet-gap batches, a pending set with timers, and incremental upkeep of the graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A burst of at most QUICK_FILES waits only QUICK_GAP_MS; larger ones the whole gap.
QUICK_FILES, QUICK_GAP_MS, GAP_MS = 2, 300, 2000
#: More pending files than this are handled by a whole comparison.
SCOPED_MOST = 500


def sessions(events: DataFrame, key: str, ts: str, gap: str | Column = "30 minutes") -> DataFrame:
    """(key, start_ts, last_ts, n_events): runs of events without a quiet gap; works on batches and streams alike.

    On a stream set a watermark on ``ts`` first; a session comes out when the watermark passes its end.
    """
    grouped = events.groupBy(key, F.session_window(ts, gap).alias("w"))
    out = grouped.agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("last_ts"))
    return out.select(key, F.col("w.start").alias("start_ts"), "last_ts", "n_events")


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window start, kind, n): tumbling or sliding counts."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_ts"), kind, "n")


class PendingFiles(StatefulProcessor):
    """Keeps the first and last change of each path and lets go once the path has been quiet for the gap.

    Changes that come while a batch is worked on restart the wait, so none is lost.
    """

    def __init__(self, gap_ms: int = GAP_MS):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_ms long, last_ms long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, last, n = self.seen.get() if self.seen.exists() else (None, None, 0)
        for part in rows:
            ms = part["ts"].astype("int64") // 1_000_000 if part["ts"].dtype.kind == "M" else part["ts"]
            low, high = int(ms.min()), int(ms.max())
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(part)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.seen.update((first, last, n))
        self.handle.registerTimer(last + self.gap_ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            first, last, n = self.seen.get()
            self.seen.clear()
            yield pd.DataFrame({"path": pd.Series([str(key[0])], dtype=object), "first_ms": [first], "last_ms": [last], "n": [n]})

    def close(self) -> None:
        pass


def pending_files(events: DataFrame, gap_ms: int = GAP_MS, watermark: str = "1 second") -> DataFrame:
    """(path, first_ms, last_ms, n) of a stream (path, ts), each path once it is quiet; needs the RocksDB state store."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("path")
        .transformWithStateInPandas(PendingFiles(gap_ms), "path string, first_ms long, last_ms long, n long", "Append", "EventTime")
    )


def debounce(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Bursts with the adaptive gap: after QUICK_FILES events or fewer a short quiet time ends the burst, else the whole gap."""
    quick = sessions(events, key, ts, f"{QUICK_GAP_MS} milliseconds")
    whole = sessions(events, key, ts, f"{GAP_MS} milliseconds")
    small = quick.where(F.col("n_events") <= QUICK_FILES).withColumn("gap_ms", F.lit(QUICK_GAP_MS))
    large = quick.where(F.col("n_events") > QUICK_FILES).select(F.col(key).alias("k"), F.col("start_ts").alias("s"))
    # A whole-gap burst counts where it holds a quick burst that was too large to go off.
    big = whole.join(large, (F.col(key) == F.col("k")) & (F.col("s") >= F.col("start_ts")) & (F.col("s") <= F.col("last_ts")), "left_semi").withColumn("gap_ms", F.lit(GAP_MS))
    inside = big.select(F.col(key).alias("k"), F.col("start_ts").alias("s"), F.col("last_ts").alias("l"))
    alone = small.join(inside, (F.col(key) == F.col("k")) & (F.col("start_ts") >= F.col("s")) & (F.col("start_ts") <= F.col("l")), "left_anti")
    return alone.unionByName(big)


def retry_delay_ms(failures: int, base_ms: int = GAP_MS, cap_ms: int = 30_000, most: int = 5) -> int | None:
    """Wait before the next try: doubling, capped; None once ``most`` failures are passed."""
    return None if failures > most else min(base_ms * 2 ** max(0, failures - 1), cap_ms)


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Works off everything that has arrived, batch by batch, and stops; progress is kept in ``checkpoint``.

    ``each`` must be idempotent per batch id: a batch interrupted by a failure runs again.
    """
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def file_stream(spark: SparkSession, folder: str, schema, names: str = "*.parquet", per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder whose names match a glob, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", names).parquet(folder)
