"""Line ranges: merging, overlap, containment, difference, and unified diffs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines per bin of an overlap join.
BIN = 256


def _islands(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce(F.col("s") > before + gap, F.lit(True)).cast("int"))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def merge_ranges(df: DataFrame, key: str, start: str = "start_line", end: str = "end_line", gap: int = 1) -> DataFrame:
    """(key, start, end): ranges of each key, merged where they overlap or lie at most ``gap`` lines apart.

    Null or reversed ranges are left out.  Ranges are merged among those that
    start in the same bin first, so a key with very many ranges comes to its one
    task as a few per bin.
    """
    rows = df.select(F.col(key), F.col(start).alias("s"), F.col(end).alias("e")).where("s <= e")
    coarse = _islands(rows.withColumn("bin", F.floor(F.col("s") / BIN)), [key, "bin"], gap)
    return _islands(coarse.drop("bin"), [key], gap).select(key, F.col("s").alias(start), F.col("e").alias(end))


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlap_join(spans: DataFrame, ranges: DataFrame, span_key: str, range_key: str, width: int = BIN) -> DataFrame:
    """Spans (span_key, start_line, end_line ...) with the ranges (range_key, r_start, r_end ...) they overlap.

    Joined by key and line bin, so a long file is many small groups; a pair that
    meets in several bins is kept in the first one only.
    """
    a = _binned(spans.where("start_line <= end_line"), "start_line", "end_line", width).withColumnRenamed("__bin", "__a")
    b = _binned(ranges.where("r_start <= r_end"), "r_start", "r_end", width).withColumnRenamed("__bin", "__b")
    met = a.join(b, (F.col(span_key) == F.col(range_key)) & (F.col("__a") == F.col("__b")))
    first = F.floor(F.greatest("start_line", "r_start") / width)
    return met.where("start_line <= r_end and r_start <= end_line").where(F.col("__a") == first).drop("__a", "__b")


def changed_symbols(nodes: DataFrame, ranges: DataFrame, skip: tuple[str, ...] = ("file", "import", "export", "parameter", "namespace")) -> DataFrame:
    """Symbols whose span meets a changed range (file_path -> path, r_start, r_end), narrowest first by ``span``."""
    met = overlap_join(nodes.where(~F.col("kind").isin(*skip)), ranges, "file_path", "path")
    return met.select("id", "name", "kind", "file_path", "start_line", "end_line").distinct().withColumn("span", F.col("end_line") - F.col("start_line"))


def enclosing_scope(nodes: DataFrame, points: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class", "component")) -> DataFrame:
    """``points`` (point_id, path, line) with the id of the narrowest symbol of the kinds around the line, or null."""
    at = points.select("point_id", F.col("path"), F.col("line").alias("r_start"), F.col("line").alias("r_end"))
    around = overlap_join(nodes.where(F.col("kind").isin(*kinds)).select("id", "file_path", "start_line", "end_line"), at, "file_path", "path")
    best = around.groupBy(F.col("point_id").alias("__p")).agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("id"))).alias("scope_id"))
    return points.join(best, F.col("point_id") == F.col("__p"), "left").drop("__p")


def nearest_symbol(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, id): of the symbols named ``name`` in ``path``, the one whose span lies nearest to ``line``."""
    met = points.select("point_id", F.col("path"), F.col("name").alias("p_name"), F.col("line").alias("p_line")).join(
        nodes, (F.col("path") == F.col("file_path")) & (F.col("p_name") == F.col("name"))
    )
    off = F.abs(F.col("start_line") - F.col("p_line")) + F.abs(F.col("end_line") - F.col("p_line"))
    return met.groupBy("point_id").agg(F.min_by("id", F.struct(off, F.col("id"))).alias("id"))


def subtract_ranges(whole: DataFrame, minus: DataFrame, key: str) -> DataFrame:
    """(key, start_line, end_line): what is left of merged ranges ``whole`` without merged ranges ``minus``."""
    events = whole.select(key, F.col("start_line").alias("at"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        whole.select(key, (F.col("end_line") + 1).alias("at"), F.lit(-1).alias("a"), F.lit(0).alias("b"))
    )
    events = events.unionByName(minus.select(key, F.col("start_line").alias("at"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    events = events.unionByName(minus.select(key, (F.col("end_line") + 1).alias("at"), F.lit(0).alias("a"), F.lit(-1).alias("b")))
    steps = events.groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(key).orderBy("at")
    level = steps.select(key, "at", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"), F.lead("at").over(w).alias("next"))
    return merge_ranges(level.where("a > 0 and b <= 0 and next is not null").select(key, F.col("at").alias("start_line"), (F.col("next") - 1).alias("end_line")), key)


# Read alike by Python and by the JVM: the two lines that open a file's part of a diff, and the new side of a hunk.
_FILE_HEAD = r"(?m)^--- ([^\t\r\n]*)[^\n]*\n\+\+\+ ([^\t\r\n]*)[^\n]*$"
_PART = r"(?m)^(?=diff --git )|^(?=--- [^\n]*\n\+\+\+ )"
_NEW_SIDE = r"(?m)^@@[\s\u00a0]+-\d+(?:,\d+)?[\s\u00a0]+\+(\d+)(?:,(\d+))?[\s\u00a0]+@@"


def parse_diff(text: str, path: str = "") -> list[tuple[str, int, int]]:
    """(path, start, end) on the new side of each hunk of one text, as ``diff_ranges`` takes them from many."""
    out = []
    for part in re.split(_PART, text):
        head = re.search(_FILE_HEAD, part)
        sides = [re.sub(r"^[ab]/", "", x.strip()) for x in head.groups()] if head else []
        name = next((x for x in reversed(sides) if x != "/dev/null"), path)
        spans = [(int(a), int(n or 1)) for a, n in re.findall(_NEW_SIDE, part)]
        out += [(name, a, a + n - 1) for a, n in spans if n and name]
    return out


def diff_ranges(df: DataFrame, id_column: str, text: str, path: str | None = None) -> DataFrame:
    """(id, path, start_line, end_line): merged changed ranges of unified diffs; null texts have none.

    A text is cut before each file's two head lines; the new sides of all hunks of a
    part come out of one expression.  ``path`` names the file of hunks before any head;
    deletions only have no lines on the new side.
    """
    given = (F.col(path) if path else F.lit("")).cast("string")
    parts = df.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.coalesce(given, F.lit("")).alias("given"), F.explode(F.split(text, _PART)).alias("part"))

    def side(group: int):
        return F.regexp_replace(F.trim(F.regexp_extract("part", _FILE_HEAD, group)), "^[ab]/", "")

    named = [F.when(~side(k).isin("", "/dev/null"), side(k)) for k in (2, 1)]
    first, size = (F.regexp_extract_all("part", F.lit(_NEW_SIDE), F.lit(k)) for k in (1, 2))
    spans = F.arrays_zip(first.alias("a"), size.alias("n"))
    hunks = parts.select("id", F.coalesce(*named, "given").alias("path"), F.explode(spans).alias("h"))
    lines = hunks.select("id", "path", F.col("h.a").cast("long").alias("start_line"), F.when(F.col("h.n") == "", 1).otherwise(F.col("h.n").cast("long")).alias("n"))
    kept = lines.where("n > 0 and path <> ''").select(F.struct("id", "path").alias("key"), "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"))
    return merge_ranges(kept, "key").select("key.id", "key.path", "start_line", "end_line")
