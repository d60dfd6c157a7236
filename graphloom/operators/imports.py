"""Import resolution: every language's rules become candidate paths, and one join finds the files.

A reference gives a short list of candidate paths in order of preference, each
either the whole path of a file or the end of one.  Whole paths join on the path,
ends join on the file's own name.  Nothing loops over references.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import base_name, shared_directories
from graphloom.runtime import staged

WEB = ("javascript", "jsx", "typescript", "tsx", "arkts", "vue", "svelte", "astro")
_WEB_TAILS = ("", ".ts", ".tsx", ".d.ts", ".ets", ".js", ".jsx", ".mjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.ets")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def joined_path(folder: Column, name: Column) -> Column:
    return normal_path(F.concat_ws("/", folder, name))


def _candidate(path: Column, whole: bool, confidence: float) -> Column:
    return F.struct(path.alias("path"), F.lit(whole).alias("whole"), F.lit(confidence).alias("confidence"))


def candidate_paths(name: Column, path: Column, language: Column, include_dirs: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> Column:
    """Array of (path, whole, confidence) that an imported name may stand for, best first."""
    here = folder_of(path)
    dotted = F.replace(name, F.lit("."), F.lit("/"))
    colons = F.replace(name, F.lit("::"), F.lit("/"))

    include = [_candidate(joined_path(here, name), True, 0.92), *[_candidate(joined_path(F.lit(d), name), True, 0.9) for d in include_dirs], _candidate(normal_path(name), False, 0.85)]
    relative = [_candidate(joined_path(here, name), True, 0.9)]

    target = name
    for alias, to in (aliases or {}).items():
        target = F.when(target.startswith(alias), F.concat(F.lit(to), F.substring(target, len(alias) + 1, 10_000))).otherwise(target)
    local = F.when(name.startswith("."), joined_path(here, name)).otherwise(normal_path(target))
    known = name.startswith(".") | (target != name)
    web = [_candidate(F.when(known, F.concat(local, F.lit(t))), True, 0.9) for t in _WEB_TAILS] + [_candidate(F.when(~known, F.concat(local, F.lit(t))), False, 0.7) for t in _WEB_TAILS[1:8]]

    # Python: leading dots climb; the last part may be a member of the module.
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    up = F.when(dots > 0, F.concat(here, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))).otherwise(F.lit(""))
    body = F.replace(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit("/"))
    less = F.regexp_replace(body, r"/?[^/]+$", "")
    python = [
        _candidate(F.when(dots > 0, F.concat(joined_path(up, b), F.lit(t))).when(b != "", F.concat(b, F.lit(t))), False, c) for b, c in ((body, 0.9), (less, 0.85)) for t in (".py", "/__init__.py", ".pyi")
    ]
    jvm = [_candidate(F.concat(d, F.lit(t)), False, c) for d, c in ((dotted, 0.9), (F.regexp_replace(dotted, r"/[^/]+$", ""), 0.8)) for t in (".java", ".kt", ".scala")]
    crate = F.regexp_replace(colons, r"^(crate|self)/", "")
    rust_body = F.when(name.startswith("super::"), joined_path(folder_of(here), F.regexp_replace(colons, r"^super/", ""))).otherwise(crate)
    rust = [_candidate(F.concat(b, F.lit(t)), False, c) for b, c in ((rust_body, 0.9), (F.regexp_replace(rust_body, r"/[^/]+$", ""), 0.85)) for t in (".rs", "/mod.rs", "/lib.rs")]
    lua = [_candidate(F.concat(dotted, F.lit(t)), False, 0.9) for t in (".lua", "/init.lua")]
    csharp_dart = [_candidate(F.regexp_replace(name, r"^package:[^/]+/", ""), False, 0.85), _candidate(joined_path(here, name), True, 0.9)]
    copybook = [_candidate(F.concat(F.lower(name), F.lit(t)), False, 0.9) for t in (".cpy", ".cbl", ".cob")]
    return F.filter(
        F.when(language.isin("c", "cpp", "objc"), F.array(*include))
        .when(language.isin(*WEB), F.array(*web))
        .when(language == "python", F.array(*python))
        .when(language.isin("java", "kotlin", "scala"), F.array(*jvm))
        .when(language == "rust", F.array(*rust))
        .when(language.isin("lua", "luau"), F.array(*lua))
        .when(language == "cobol", F.array(*copybook))
        .when(language.isin("dart", "csharp"), F.array(*csharp_dart))
        .otherwise(F.array(*relative)),
        lambda c: c["path"].isNotNull() & (c["path"] != ""),
    )


def to_files(refs: DataFrame, nodes: DataFrame, include_dirs: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> DataFrame:
    """(ref_id, target, target_path, confidence): the file each import reference means.

    ``refs`` is what ``clean_refs`` gives.  Of several files with the same end the
    one sharing most leading folders wins, then the least path.
    """
    asked = refs.where("reference_kind = 'imports'").select(
        "ref_id", "ref_path", F.posexplode(candidate_paths(F.col("reference_name"), F.col("ref_path"), F.col("ref_language"), include_dirs, aliases)).alias("rank", "c")
    )
    asked = asked.select("ref_id", "ref_path", "rank", "c.path", "c.whole", "c.confidence").withColumn("base", base_name(F.col("path")))
    files = nodes.where("kind = 'file'").select(F.col("id").alias("target"), F.col("file_path").alias("target_path"), base_name(F.col("file_path")).alias("f_base"))
    whole = asked.where("whole").join(files, F.col("path") == F.col("target_path"))
    ends = asked.where("not whole").join(files, F.col("base") == F.col("f_base")).where((F.col("target_path") == F.col("path")) | F.col("target_path").endswith(F.concat(F.lit("/"), F.col("path"))))
    met = whole.unionByName(ends).where("target_path <> ref_path")
    order = F.struct(F.col("rank"), -shared_directories(F.col("ref_path"), F.col("target_path")), F.col("target_path"))
    best = met.groupBy("ref_id").agg(F.min_by(F.struct("target", "target_path", "confidence"), order).alias("b"))
    return best.select("ref_id", "b.*")


def go_packages(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, confidence): pkg.Symbol where an import of the file ends in pkg and a folder of that name defines Symbol."""
    go = refs.where("ref_language = 'go'")
    imported = go.where("reference_kind = 'imports'").select(F.col("ref_path").alias("i_path"), base_name(F.col("reference_name")).alias("pkg")).distinct()
    uses = go.where("reference_kind <> 'imports' and reference_name like '%.%'").withColumn("head", F.substring_index("reference_name", ".", 1))
    met = uses.join(imported, (F.col("ref_path") == F.col("i_path")) & (F.col("head") == F.col("pkg")))
    symbols = nodes.where("language = 'go' and kind <> 'file' and name rlike '^\\\\p{Lu}'").withColumn("folder", base_name(folder_of(F.col("file_path"))))
    found = met.join(symbols, (F.col("tail") == F.col("name")) & (F.col("pkg") == F.col("folder")))
    return found.groupBy("ref_id").agg(F.min_by("id", F.struct("file_path", "start_line", "id")).alias("target")).withColumn("confidence", F.lit(0.9))


def named_imports(uses: DataFrame, mappings: DataFrame, nodes: DataFrame, reexports: DataFrame | None = None, hops: int = 8) -> DataFrame:
    """(ref_id, target, confidence): uses of imported names, followed to the symbol itself.

    ``mappings`` has file_path, local_name, imported_name ('*' for a whole module)
    and target_path; ``reexports`` has file_path, name ('*' for all), source_name and
    source_path.  A name a file does not define is looked up in what the file
    exports on, at most ``hops`` times; cycles end by the hop limit.
    """
    head = F.regexp_extract("reference_name", r"^([A-Za-z_$][\w$]*)", 1)
    rest = F.regexp_extract("reference_name", r"^[A-Za-z_$][\w$]*(?:\.|::)(.+)$", 1)
    met = uses.select("ref_id", "ref_path", head.alias("head"), rest.alias("rest")).join(mappings, (F.col("ref_path") == F.col("file_path")) & (F.col("head") == F.col("local_name")))
    wanted = F.when(F.col("imported_name") == "*", F.regexp_extract("rest", r"^(\w+)", 1)).otherwise(F.col("imported_name"))
    open_ = met.select("ref_id", wanted.alias("want"), F.col("target_path").alias("at")).where("want <> ''").distinct()
    defined = nodes.where("kind not in ('import', 'file')").select(F.col("id").alias("d_id"), F.col("name").alias("d_name"), F.col("file_path").alias("d_path"), "start_line")
    found = []
    for hop in range(hops + 1):
        hit = open_.join(defined, (F.col("want") == F.col("d_name")) & (F.col("at") == F.col("d_path")))
        hit = staged(hit.groupBy("ref_id").agg(F.min_by("d_id", F.struct("start_line", "d_id")).alias("target")), "hit")
        found.append(hit.withColumn("hop", F.lit(hop)))
        if reexports is None:
            break
        left = open_.join(hit, "ref_id", "left_anti")
        r = reexports.select(F.col("file_path").alias("r_path"), F.col("name").alias("r_name"), F.col("source_name").alias("r_source"), F.col("source_path").alias("r_to"))
        step = left.join(r, (F.col("at") == F.col("r_path")) & ((F.col("r_name") == F.col("want")) | (F.col("r_name") == "*")))
        open_ = staged(step.select("ref_id", F.when(F.col("r_name") == "*", F.col("want")).otherwise(F.col("r_source")).alias("want"), F.col("r_to").alias("at")).distinct(), "open")
        if open_.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("ref_id").agg(F.min_by("target", F.struct("hop", "target")).alias("target")).withColumn("confidence", F.lit(0.9))
