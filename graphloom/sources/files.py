"""Source trees as tables: scanning, language detection, ignore rules, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import map_of

#: Files above this size are listed but not read.
SIZE_CAP = 1 << 20
# Extension to language.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "ets": "arkts", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
    "m": "objc", "mm": "objc", "cs": "csharp", "dart": "dart", "vue": "vue", "svelte": "svelte", "swift": "swift", "rb": "ruby", "php": "php", "scala": "scala", "lua": "lua", "tf": "terraform",
    "yaml": "yaml", "yml": "yaml", "properties": "properties", "cbl": "cobol", "nix": "nix",
}
# Folders that hold no source of their own.
IGNORED = "node_modules bower_components .git .hg .svn dist build out target vendor Pods .venv venv __pycache__ .tox .mypy_cache .gradle .idea .vscode coverage .next .nuxt".split()


def language_of(path: Column, head: Column | None = None) -> Column:
    """Language by extension; a header is C++ or Objective-C if its first characters say so; else 'unknown'."""
    out = F.coalesce(map_of(LANGUAGES, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))), F.lit("unknown"))
    if head is None:
        return out
    is_header = F.lower(path).endswith(".h")
    return F.when(is_header & head.rlike(r"@interface|@protocol|#import"), "objc").when(is_header & head.rlike(r"\b(class|namespace|template)\b|std::"), "cpp").otherwise(out)


def ignored(path: Column, folders: list[str] | None = None) -> Column:
    names = "|".join(n.replace(".", r"\.") for n in (IGNORED if folders is None else folders))
    return path.rlike(rf"(^|/)({names})/")


def ignore_rules(path: Column, patterns: list[str]) -> Column:
    """Whether the last matching rule of a git-style ignore list excludes the path."""
    out = F.lit(False)
    for raw in patterns:
        rule = raw.strip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule[1:] if keep else rule
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body, i = "", 0
        rule = rule.lstrip("/")
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(.*/)?", i + 3
            elif rule.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                c = rule[i]
                body += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".^$+(){}|\\" else c)
                i += 1
        regex = ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")
        out = F.when(path.rlike(regex), F.lit(not keep)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, text, language, size, modified_at, content_hash, oversize) of the files below ``root``.

    Paths, sizes and times are listed first; ignored folders and files of unknown
    extension are dropped by these.  The length is pruned inside the source, so the
    content of oversize files is not read: they come without text and hash.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/")
    plain = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + prefix.replace(".", r"\.") + "/", "")

    def wanted(rows: DataFrame) -> DataFrame:
        rows = rows.where(~ignored(F.col("path")) & (language_of(F.col("path")) != "unknown"))
        return rows.where(~ignore_rules(F.col("path"), patterns)) if patterns else rows

    listed = (F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    small = wanted(raw.where(F.col("length") <= SIZE_CAP).select(plain.alias("path"), *listed, "content")).withColumn("text", F.decode("content", "UTF-8"))
    big = wanted(raw.where(F.col("length") > SIZE_CAP).select(plain.alias("path"), *listed))
    none = F.lit(None).cast("string")
    out = small.select("path", "text", language_of(F.col("path"), F.substring("text", 1, 8192)).alias("language"), "size", "modified_at", F.sha2("content", 256).alias("content_hash"), F.lit(False).alias("oversize"))
    return out.unionByName(big.select("path", none.alias("text"), language_of(F.col("path")).alias("language"), "size", "modified_at", none.alias("content_hash"), F.lit(True).alias("oversize")))


def generated_header(text: Column) -> Column:
    """Whether a comment line among the first sixty says that a tool wrote the file."""
    lines = F.slice(F.split(F.substring(text, 1, 8192), "\n"), 1, 60)
    return F.coalesce(F.exists(lines, lambda x: x.rlike(r"(?i)^\s*(//|#|/?\*|--|;|<!--).*(code generated .* do not edit|@generated|auto-?generated|do not (edit|modify) (this file|by hand)|generated by)")), F.lit(False))


def headings(markdown: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, title, subtitles): the first top heading (or first line) and the second-level headings of markdown texts."""
    first = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)
    title = F.when(first != "", first).otherwise(F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1)))
    return markdown.select(F.col(id_column).alias("id"), title.alias("title"), F.regexp_extract_all(text, F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1)).alias("subtitles"))


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, author, ts_ms, message) from ``git log --format=%H%x1f%an%x1f%ct%x1f%B%x00`` output kept in files."""
    rows = spark.read.option("lineSep", "\0").text(path).where(F.col("value").rlike(r"\S"))
    f = F.split(F.regexp_replace("value", r"^\s+", ""), "\x1f", 4)
    return rows.select(F.trim(f[0]).alias("hash"), f[1].alias("author"), (f[2].cast("long") * 1000).alias("ts_ms"), F.regexp_replace(f[3], r"\s+$", "").alias("message"))
