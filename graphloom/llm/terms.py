"""Frequency of every term of a collection (problem 3).

A global integer dictionary is built by a range sort of the distinct terms;
terms are encoded with it; each task adds its share into count arrays, and the
arrays are summed by identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import shuffle_partitions, staged

#: Identifiers per range; one pair of count arrays is held for each range a task owns.
RANGE = 1 << 14


def split_terms(text: Column) -> Column:
    """Lower-cased pieces of a name: runs of letters and digits, cut at case changes, digits-only dropped.

    Null gives null, a text without letters an empty array.
    """
    cut = F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    pieces = F.regexp_extract_all(cut, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.transform(F.filter(pieces, lambda p: p.rlike(r"\p{L}")), lambda p: F.lower(p))


def global_dictionary(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, term_id): distinct terms numbered 0, 1, 2 ... in code point order.

    A range sort gives each task a slice; the slices' sizes (one row per task)
    give each slice its first number.
    """
    spark = terms.sparkSession
    n = shuffle_partitions(spark)
    ordered = terms.select(F.col(column).alias("term")).distinct().repartitionByRange(n, "term").sortWithinPartitions("term")
    slices = staged(
        ordered.select("term", F.monotonically_increasing_id().alias("at")).select(
            "term", F.shiftright("at", 33).alias("slice"), F.col("at").bitwiseAND((1 << 33) - 1).alias("offset")
        ),
        "dictionary",
    )
    first, starts = 0, []
    for part, size in sorted(tuple(r) for r in slices.groupBy("slice").count().collect()):  # one row per task
        starts.append((part, first))
        first += size
    firsts = spark.createDataFrame(starts, "slice long, first long")
    return slices.join(F.broadcast(firsts), "slice").select("term", (F.col("first") + F.col("offset")).alias("term_id"))


def _sum_arrays(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            counts = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            ranges = ids // size
            order = np.argsort(ranges, kind="stable")
            ids, counts, ranges = ids[order], counts[:, order], ranges[order]
            edges = np.flatnonzero(np.diff(ranges, prepend=-1)) if len(ranges) else []
            for lo, hi in zip(edges, [*edges[1:], len(ranges)]):
                block = arrays.setdefault(int(ranges[lo]), np.zeros((2, size), np.int64))
                np.add.at(block, (slice(None), ids[lo:hi] % size), counts[:, lo:hi])
        for r, block in arrays.items():
            at = np.flatnonzero(block[0])
            for lo in range(0, len(at), 10_000):
                part = at[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part + r * size), pa.array(block[0][part]), pa.array(block[1][part])],
                    names=["term_id", "occurrences", "records"],
                )

    return run


def term_frequencies(
    df: DataFrame,
    id_column: str,
    text_columns: list[str],
    rare_below: int = 3,
    common_above: float = 0.05,
) -> DataFrame:
    """(term, occurrences, records, mark) over the distinct ids of ``df``.

    A record is a distinct non-null id; if rows of an id differ, the greatest
    value of each text column counts.  Null texts have no terms, an empty table
    gives no rows.  mark is ``rare`` (fewer than ``rare_below`` records),
    ``common`` (more than ``common_above`` of all records) or null.
    """
    records = (
        df.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(*[F.max(c).alias(f"__t{i}") for i, c in enumerate(text_columns)])
    )
    terms = F.coalesce(split_terms(F.concat_ws("\n", *[f"__t{i}" for i in range(len(text_columns))])), F.array().cast("array<string>"))
    tokens = records.select(F.spark_partition_id().alias("block"), terms.alias("terms")).select(
        "block",
        # A null term per record counts the records in the same pass.
        F.posexplode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("pos", "term"),
        "terms",
    )
    first = F.when(F.col("term").isNull(), 1).otherwise((F.array_position("terms", F.col("term")) == F.col("pos") + 1).cast("int"))
    # Summed per block in the map tasks: a term that is everywhere costs one row per block.
    blocks = staged(
        tokens.select("block", "term", first.alias("first"))
        .groupBy("block", "term")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.sum("first").alias("records")),
        "terms",
    )
    total = blocks.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    counted = blocks.where("term is not null")
    dictionary = staged(global_dictionary(counted), "dictionary")
    encoded = counted.join(dictionary, "term").select("term_id", "occurrences", "records")
    summed = encoded.repartition(F.expr(f"term_id div {RANGE}")).mapInArrow(
        _sum_arrays(RANGE), "term_id long, occurrences long, records long"
    )
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.lit(total), "common")
    return summed.join(dictionary, "term_id").select("term", "occurrences", "records", mark.alias("mark"))
