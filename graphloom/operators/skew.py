"""Per-key results when a few keys hold most of the rows (problem 1).

Heavy hitters are found with a mergeable frequent-items sketch (one pass,
bounded state), their rows take the broadcast route, every other row takes the
ordinary shuffle, and the two results are united.  No row is dropped, sampled
or capped on either route.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import BROADCAST_ROWS, bounded

#: Counters a sketch keeps per task.  A key with more than rows/CAPACITY rows is never missed.
CAPACITY = 1024


def _sketch_partition(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        rows = lost = 0
        for batch in batches:
            rows += batch.num_rows
            seen = batch.column(0).value_counts()
            for key, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                counters[key] = counters.get(key, 0) + n
            if len(counters) > capacity:
                # Misra-Gries: subtract the (capacity+1)-largest count from all counters.
                cut = sorted(counters.values(), reverse=True)[capacity]
                lost += cut
                counters = {k: v - cut for k, v in counters.items() if v > cut}
        keys = list(counters)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k is None for k in keys] + [True], pa.bool_()),
                pa.array([*keys, None], pa.string()),
                pa.array([counters[k] for k in keys] + [0], pa.int64()),
                pa.array([0] * len(keys) + [lost], pa.int64()),
                pa.array([0] * len(keys) + [rows], pa.int64()),
            ],
            names=["is_null", "key", "n", "lost", "rows"],
        )

    return run


def heavy_hitters(df: DataFrame, key: str, share: float, capacity: int = CAPACITY) -> tuple[list, int]:
    """Keys that may hold at least ``share`` of all rows, and the number of rows.

    Every key at or above the share is returned (Misra-Gries underestimates by
    at most the sum of the tasks' ``lost``, which is added back); at most
    ``2 / share`` keys come back, so the list is small whatever the data.
    ``None`` stands for the null key.  An empty table gives ``([], 0)``.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    capacity = max(capacity, math.ceil(4 / share))
    part = df.select(F.col(key).cast("string").alias("key")).mapInArrow(
        _sketch_partition(capacity), "is_null boolean, key string, n long, lost long, rows long"
    )
    merged = part.groupBy("key").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"), F.sum("rows").alias("rows"))
    # The null row carries the totals, so one small job gives sketch and row count alike.
    totals = merged.where(F.col("key").isNull()).agg(F.sum("rows"), F.sum("lost")).first()
    rows, lost = int(totals[0] or 0), int(totals[1] or 0)
    if not rows:
        return [], 0
    least = share * rows - lost
    found = (
        merged.where((F.col("n") >= least) & (F.col("n") > 0))
        .orderBy(F.desc("n"), F.col("key"))
        .limit(math.ceil(2 / share))
        .select("key")
        .collect()
    )
    return [r[0] for r in found], rows


def _heavy_frame(df: DataFrame, key: str, heavy: list) -> DataFrame:
    return df.sparkSession.createDataFrame([(k,) for k in heavy], "heavy_key string")


def split_by_weight(df: DataFrame, key: str, heavy: list) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys, all other rows); null keys count as a key."""
    if not heavy:
        return df.limit(0), df
    keys = F.broadcast(_heavy_frame(df, key, heavy))  # at most 2 / share rows
    same = F.col(key).cast("string").eqNullSafe(F.col("heavy_key"))
    return df.join(keys, same, "left_semi"), df.join(keys, same, "left_anti")


def per_key(
    df: DataFrame,
    key: str,
    aggs: dict[str, Column],
    distinct: dict[str, str] | None = None,
    share: float = 0.01,
    heavy: list | None = None,
) -> DataFrame:
    """One row per key value with the given results, whatever the skew.

    ``aggs`` maps result names to decomposable aggregates (count, sum, min,
    max ...): heavy keys are combined in the map tasks and at most one row per
    task and key is shuffled.  ``distinct`` maps result names to columns whose
    distinct non-null values are counted exactly: rows of heavy keys are spread by
    (key, value) first, so no task sees a heavy key whole.

    Null keys form one group of their own (key null); an empty table gives no
    rows; repeated rows count as stored; other columns may carry any name.
    """
    distinct = distinct or {}
    names = [key, *aggs, *distinct]
    if len(set(names)) != len(names):
        raise ValueError("result names must differ from each other and from the key")
    if heavy is None:
        heavy, _ = heavy_hitters(df, key, share)
    hot, rest = split_by_weight(df, key, heavy)
    cold = rest.groupBy(key).agg(
        *[c.alias(n) for n, c in aggs.items()],
        *[F.countDistinct(F.col(c)).alias(n) for n, c in distinct.items()],
        F.lit(1).alias("__one"),
    ).drop("__one")
    if not heavy:
        return cold.select(*names)
    out = hot.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()], F.lit(1).alias("__one")).drop("__one")
    for name, column in distinct.items():
        spread = hot.select(F.col(key), F.col(column).alias("__v")).distinct()
        counted = spread.groupBy(F.col(key).alias("__k")).agg(F.count("__v").alias(name))
        # At most 2 / share rows on either side.
        out = out.join(F.broadcast(counted), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    return out.select(*names).unionByName(cold.select(*names))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    share: float = 0.01,
    salts: int = 32,
    heavy: list | None = None,
) -> DataFrame:
    """Equi-join (inner or left) of a skewed ``left`` with ``right``.

    Rows of heavy left keys meet the right rows of those keys by broadcast, as
    long as these are few (counted, at most ``BROADCAST_ROWS``); else the heavy
    left rows are salted and the heavy right rows repeated per salt.  The rest is
    an ordinary shuffle join.  Null keys never match; ``left`` keeps them.
    The column sets of both sides must be disjoint.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if heavy is None:
        heavy, _ = heavy_hitters(left, left_key, share)
    hot, rest = split_by_weight(left, left_key, heavy)
    cold = rest.join(right, F.col(left_key) == F.col(right_key), how)
    if not heavy:
        return cold
    hot_right, _ = split_by_weight(right, right_key, [k for k in heavy if k is not None])
    if bounded(hot_right, BROADCAST_ROWS):
        warm = hot.join(F.broadcast(hot_right), F.col(left_key) == F.col(right_key), how)
    else:
        salted = hot.withColumn("__salt", F.pmod(F.xxhash64(*hot.columns), F.lit(salts)).cast("int"))
        copies = hot_right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        warm = salted.join(
            copies, (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__salt_r")), how
        ).drop("__salt", "__salt_r")
    return warm.unionByName(cold)
