"""Mixing sources to target shares of tokens (problem 7).

Rows get hash-random keys and are range-sorted within their source; prefix sums
of token counts run inside each slice and are shifted by the sums of the slices
before it; each source is cut where its budget ends, after as many full epochs
as the budget asks for and the source allows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.runtime import shuffle_partitions, staged

#: Vocabulary of ranks (base64 token, rank) of a public byte-level BPE.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with that vocabulary.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes):
    """The encoder of a vocabulary; built once per worker process."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("mixing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def count_tokens(df: DataFrame, text: str, out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with the token count of ``text`` in ``out``, without the text itself.

    Null texts have null tokens, empty texts 0; strings that look like special
    tokens count as ordinary text.  The vocabulary is read on the driver and
    shared, so executors need no copy of the file.
    """
    if out.lower() in {c.lower() for c in df.columns if c != text}:
        raise ValueError(f"column {out} exists")
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            counts = [None if t is None else len(encoder.encode_ordinary(t)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64())], names=[*keep, out])

    fields = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))


class Mix:
    """A mixture: ``records`` chosen with their ``copies``, and the ``shares`` reached."""

    def __init__(self, records: DataFrame, shares: DataFrame):
        self.records, self.shares = records, shares


def mix_sources(sized: DataFrame, targets: DataFrame, id_column: str, source: str, tokens: str, total_tokens: int | None = None, seed: int = 7) -> Mix:
    """Chooses rows of ``sized`` so that each source gets its target share of tokens.

    ``targets`` has source, target_share and max_repeats (one row per source).
    The total defaults to the tokens of all rows that have a target.  A source's
    budget is its share of the total; it is met by full epochs, at most
    ``max_repeats``, and then by the rows whose prefix sum stays within the rest,
    so a source ends less than one record below its budget unless it is too small
    (``limited``).  ``actual_share`` is measured on what was chosen, ``share_of_total``
    on the total asked for.  Rows with null source, no target or null tokens take no part;
    a target without rows is reported with nothing chosen; null shares count as 0,
    null repeats as 1.  Rows repeated under one id count as stored.
    """
    spark = sized.sparkSession
    goals = targets.select(
        F.col("source").alias("goal_source"),
        F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"),
    ).where("goal_source is not null")
    rows = (
        sized.select(F.col(id_column).alias("id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens"))
        .where("source is not null and tokens is not null")
        .join(goals, F.col("source") == F.col("goal_source"), "left_semi")
        .withColumn("key", F.xxhash64("id", F.lit(seed)))
    )
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "source", "key", "id")
    sliced = staged(ordered.withColumn("slice", F.spark_partition_id()), "mix")
    sums = sliced.groupBy("source", "slice").agg(F.sum("tokens").alias("slice_tokens"))  # slices + sources rows at most
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "slice", F.coalesce(F.sum("slice_tokens").over(before), F.lit(0)).alias("start"))
    available = sums.groupBy("source").agg(F.sum("slice_tokens").alias("available_tokens"))
    if total_tokens is None:
        total_tokens = available.agg(F.coalesce(F.sum("available_tokens"), F.lit(0))).first()[0]
    budget = F.floor(F.col("target_share") * F.lit(total_tokens)).cast("long")
    has = F.coalesce(F.col("available_tokens"), F.lit(0))
    epochs = F.when(has > 0, F.least(F.expr("budget_tokens div available_tokens"), F.col("max_repeats"))).otherwise(0)
    plan = (
        goals.join(available, goals.goal_source == available.source, "left")
        .select(F.col("goal_source").alias("plan_source"), "target_share", "max_repeats", has.alias("available_tokens"), budget.alias("budget_tokens"))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens")).otherwise(0))
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sliced.withColumn("prefix", F.sum("tokens").over(inside))
        .join(starts, ["source", "slice"])
        .withColumn("prefix", F.col("prefix") + F.col("start"))
        .join(plan, F.col("source") == F.col("plan_source"))
    )
    more: Column = (F.col("prefix") <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    copies = (F.col("epochs") + more.cast("int")).cast("int")
    records = placed.select("id", "source", "tokens", copies.alias("copies")).where("copies > 0")
    chosen = records.groupBy(F.col("source").alias("chosen_source")).agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"), F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies")
    )
    everything = Window.partitionBy(F.lit(0))  # one row per source
    shares = (
        plan.join(chosen, F.col("plan_source") == F.col("chosen_source"), "left")
        .select(
            F.col("plan_source").alias("source"),
            "target_share",
            "available_tokens",
            "budget_tokens",
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("chosen_tokens", "records", "copies")],
            (F.col("available_tokens") * F.col("max_repeats") < F.col("budget_tokens")).alias("limited"),
        )
        .withColumn("actual_share", F.col("chosen_tokens") / F.greatest(F.sum("chosen_tokens").over(everything), F.lit(1)))
        .withColumn("share_of_total", F.col("chosen_tokens") / F.greatest(F.lit(total_tokens), F.lit(1)))
    )
    return Mix(records, shares)
