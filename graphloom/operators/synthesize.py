"""Edges that no name in the text spells out: routes, observers, events, function pointers.

Sites are found per file in Arrow batches; who meets whom is one join on the key,
with a cap on how many may meet where a key is too general to mean anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.code import strip_comments
from graphloom.functions.names import directory
from graphloom.operators.intervals import overlap_join

SITE = "path string, language string, role string, key string, handler string, line int"
#: A field may call so many; an event of more handlers or senders is too general.
FIELD_CAP, EVENT_CAP = 40, 6

# Web and method frameworks by the shape of their route declarations: groups route and handler.
ROUTES = {
    "express": (("javascript", "typescript"), r"\b(?:app|router|server)\.(?:get|post|put|patch|delete|all|use)\(\s*['\"`](?P<route>[^'\"`]+)['\"`]\s*,\s*(?:[\w.]+\s*,\s*)*(?P<handler>[A-Za-z_][\w.]*)\s*\)"),
    "nestjs": (("typescript",), r"@(?:Get|Post|Put|Patch|Delete|All)\(\s*(?:['\"](?P<route>[^'\"]*)['\"])?\s*\)\s*(?:@\w+\([^)]*\)\s*)*(?:public\s+|async\s+)*(?P<handler>\w+)\s*\("),
    "react-router": (("tsx", "jsx", "javascript", "typescript"), r"<Route\b[^>]*\bpath=['\"](?P<route>[^'\"]+)['\"][^>]*\b(?:element=\{<|component=\{)(?P<handler>\w+)"),
    "vue-router": (("javascript", "typescript", "vue"), r"\bpath:\s*['\"](?P<route>[^'\"]+)['\"]\s*,(?:[^{}]*?)\bcomponent:\s*(?P<handler>\w+)"),
    "flask": (("python",), r"@\w+\.route\(\s*['\"](?P<route>[^'\"]+)['\"][^)]*\)\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:async\s+)?def\s+(?P<handler>\w+)"),
    "fastapi": (("python",), r"@\w+\.(?:get|post|put|patch|delete)\(\s*['\"](?P<route>[^'\"]+)['\"][^)]*\)\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:async\s+)?def\s+(?P<handler>\w+)"),
    "django": (("python",), r"\b(?:re_)?path\(\s*r?['\"](?P<route>[^'\"]*)['\"]\s*,\s*(?P<handler>[\w.]+)"),
    "rails": (("ruby",), r"\b(?:get|post|put|patch|delete)\s+['\"](?P<route>[^'\"]+)['\"]\s*(?:,\s*to:|=>)\s*['\"](?P<handler>[\w/]+#\w+)['\"]"),
    "laravel": (("php",), r"Route::(?:get|post|put|patch|delete|any)\(\s*['\"](?P<route>[^'\"]+)['\"]\s*,\s*\[\s*\w+::class\s*,\s*['\"](?P<handler>\w+)['\"]"),
    "drupal": (("yaml",), r"\bpath:\s*['\"](?P<route>/[^'\"]+)['\"][\s\S]{0,200}?_(?:controller|form):\s*['\"]\\?(?P<handler>[\w\\:]+)['\"]"),
    "spring": (("java", "kotlin"), r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?['\"](?P<route>[^'\"]*)['\"][^)]*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|fun|suspend|static|final)\s+)*(?:[\w<>\[\],.? ]+\s+)?(?P<handler>\w+)\s*\("),
    "play": (("routes",), r"(?m)^(?:GET|POST|PUT|PATCH|DELETE)\s+(?P<route>/\S*)\s+(?P<handler>[\w.]+)"),
    "go-http": (("go",), r"\.(?:GET|POST|PUT|PATCH|DELETE|Any|Get|Post|Put|Delete|HandleFunc|Handle)\(\s*\"(?P<route>[^\"]+)\"\s*,\s*(?:[\w.]+\([^)]*\)\s*,\s*)*(?P<handler>[A-Za-z_][\w.]*)"),
    "rust-axum": (("rust",), r"\.route\(\s*\"(?P<route>[^\"]+)\"\s*,\s*(?:\w+::)*(?:get|post|put|patch|delete)\(\s*(?P<handler>[\w:]+)"),
    "rust-attribute": (("rust",), r"#\[(?:get|post|put|patch|delete)\(\s*\"(?P<route>[^\"]+)\"[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"),
    "aspnet": (("csharp",), r"\[Http(?:Get|Post|Put|Patch|Delete)(?:\(\s*\"(?P<route>[^\"]*)\"[^)]*\))?\]\s*(?:\[[^\]]*\]\s*)*(?:(?:public|async|virtual|static)\s+)*[\w<>\[\],.? ]+\s+(?P<handler>\w+)\s*\("),
    "vapor": (("swift",), r"\b(?:app|routes|router)\.(?:get|post|put|patch|delete)\(\s*\"(?P<route>[^\"]+)\"\s*,\s*use:\s*(?:\w+\.)?(?P<handler>\w+)"),
    "expo-module": (("kotlin", "swift"), r"\b(?:Async)?Function\(\s*\"(?P<route>\w+)\"\s*\)\s*(?P<handler>)\{"),
    "react-native": (("objc",), r"RCT_EXPORT_METHOD\(\s*(?P<route>(?P<handler>\w+))"),
    "arkts-entry": (("arkts",), r"@Entry\b(?P<route>)[\s\S]{0,80}?\bstruct\s+(?P<handler>\w+)"),
    "terraform": (("terraform",), r"(?m)^(?:resource|data)\s+\"(?P<route>\w+)\"\s+\"(?P<handler>\w+)\""),
}
_ROUTES = [(name, languages, re.compile(p)) for name, (languages, p) in ROUTES.items()]
# Methods by which callbacks are put into a collection, run over, bound to an event's name and called by it.
METHODS = {
    "observe": ("add", "push", "set"), "notify": ("forEach",), "on": ("on", "once", "addListener", "addEventListener", "subscribe"),
    "emit": ("emit", "fire", "dispatchEvent", "publish"),
}
_ROLE = {m: role for role, methods in METHODS.items() for m in methods}
_WORD = re.compile(r"[A-Za-z_$][\w$]*|['\"`](?:[^'\"`\\\n]|\\.)*['\"`]|\S")


def call_sites(text: str) -> Iterator[tuple[str, str, str | None, int]]:
    """(role, key, handler, place) of calls whose method has a role, read from the tokens of a text.

    A collection is a field of this; its handler is the first argument.  An event is
    named by a string, its handler the next argument.  Loops over a field count as
    running over it.
    """
    words = [(m[0], m.start()) for m in _WORD.finditer(text)]
    token = [w for w, _ in words] + [""] * 8
    for i, (word, place) in enumerate(words):
        if word == "." and token[i + 2] == "(" and (role := _ROLE.get(token[i + 1])):
            args = i + 3
            field = token[i - 1] if i >= 3 and token[i - 3 : i - 1] == ["this", "."] else None
            if role in ("observe", "notify"):
                if field:
                    yield role, field, token[args] if token[args].isidentifier() and role == "observe" else None, words[i - 3][1]
            elif token[args][:1] in ("'", '"'):
                handler = None
                if role == "on":
                    if token[args + 1] != ",":
                        continue
                    at = args + 2
                    at += 2 if token[at : at + 2] == ["this", "."] else 1 if token[at] == "function" else 0
                    handler = token[at]
                    if not handler.isidentifier():
                        continue
                yield role, token[args][1:-1], handler, place
        elif word == "of":
            at = i + 1 + (4 if token[i + 1 : i + 5] == ["Array", ".", "from", "("] else 0)
            if token[at : at + 2] == ["this", "."] and token[at + 2].isidentifier():
                yield "notify", token[at + 2], None, place


_C_SET = re.compile(r"\.(?P<a>\w+)\s*=\s*&?(?P<fa>[A-Za-z_]\w*)\s*[,}]|(?:->|\.)(?P<b>\w+)\s*=\s*&?(?P<fb>[A-Za-z_]\w*)\s*;")
_C_CALL = re.compile(r"(?:->|\.)(?P<key>\w+)\s*\(|\(\s*\*\s*\w+(?:->|\.)(?P<key2>\w+)\s*\)\s*\(")


def sites_of(path: str, text: str, language: str) -> list[tuple]:
    """(path, language, role, key, handler, line) of every site in one file; comments do not count."""
    clean = strip_comments(text, language)
    out = []

    def put(role: str, key: str | None, handler: str | None, at: int) -> None:
        out.append((path, language, role, key or "", handler or "", clean.count("\n", 0, at) + 1))

    for name, languages, pattern in _ROUTES:
        if language in languages:
            for m in pattern.finditer(clean):
                put(f"route:{name}", m["route"], m["handler"], m.start("handler") if m["handler"] else m.start())
    if language in ("javascript", "typescript", "jsx", "tsx", "arkts", "vue"):
        for role, key, handler, at in call_sites(clean):
            put(role, key, handler, at)
    if language in ("c", "cpp", "objc"):
        for m in _C_SET.finditer(clean):
            put("pointer-set", m["a"] or m["b"], m["fa"] or m["fb"], m.start())
        for m in _C_CALL.finditer(clean):
            put("pointer-call", m["key"] or m["key2"], None, m.start())
    return out


def sites(files: DataFrame) -> DataFrame:
    """All sites of files (path, text, language); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s for p, t, g in zip(*(c.to_pylist() for c in batch.columns)) if t for s in sites_of(p, t, g or "")]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (*[pa.string()] * 5, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "language", "role", "key", "handler", "line"])

    return files.select("path", "text", "language").mapInArrow(run, SITE)


def placed(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sites with the narrowest function around them (``scope``), where there is one."""
    callables = nodes.where("kind in ('function', 'method', 'component')").select("id", "file_path", "start_line", "end_line")
    at = found.withColumn("r_start", F.col("line")).withColumn("r_end", F.col("line")).withColumn("sid", F.xxhash64("path", "role", "key", "handler", "line"))
    around = overlap_join(callables, at.select("sid", "path", "r_start", "r_end").distinct(), "file_path", "path")
    scope = around.groupBy(F.col("sid").alias("s")).agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), F.col("id"))).alias("scope"))
    return at.join(scope, F.col("sid") == F.col("s"), "left").drop("r_start", "r_end", "sid", "s")


def _named(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sites with the callable their handler names: one in the same file, else the only one anywhere."""
    names = nodes.where("kind in ('function', 'method', 'component', 'class')").select(F.col("id").alias("h_id"), F.col("name").alias("h_name"), F.col("file_path").alias("h_path"))
    last = F.regexp_extract("handler", r"(\w+)$", 1)
    alone = names.groupBy("h_name").agg(F.count(F.lit(1)).alias("h_n"), F.min("h_id").alias("only"))
    local = names.groupBy("h_name", "h_path").agg(F.min("h_id").alias("own"))
    keyed = found.withColumn("want", last).where("want <> ''")
    met = keyed.join(local.withColumnRenamed("h_name", "l_name"), (F.col("want") == F.col("l_name")) & (F.col("path") == F.col("h_path")), "left").drop("l_name", "h_path")
    met = met.join(alone, F.col("want") == F.col("h_name"), "left")
    target = F.coalesce("own", F.when(F.col("h_n") == 1, F.col("only")))
    return met.withColumn("target", target).where("target is not null").drop("own", "only", "h_n", "h_name", "want")


def _edges(df: DataFrame, how: str) -> DataFrame:
    metadata = F.to_json(F.struct(F.lit(how).alias("synthesizedBy"), F.col("key").alias("via")))
    return df.where("source <> target").select("source", "target", F.lit("calls").alias("kind"), "line", F.lit("heuristic").alias("provenance"), metadata.alias("metadata")).distinct()


def route_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """From each route (by its file and path) to its handler; route rows need not exist as nodes."""
    met = _named(found.where("role like 'route:%'"), nodes)
    return met.select(F.concat_ws(":", F.lit("route"), "path", "key").alias("source"), "target", F.lit("references").alias("kind"), "line", F.substring_index("role", ":", -1).alias("framework")).distinct()


def observer_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """From what runs over a field's callbacks to the callbacks put there, by file and field, at most FIELD_CAP each."""
    there = placed(found.where("role in ('observe', 'notify')"), nodes)
    senders = there.where("role = 'notify' and scope is not null").select("path", "key", F.col("scope").alias("source"), "line").distinct()
    put = _named(there.where("role = 'observe'"), nodes).select(F.col("path").alias("p"), F.col("key").alias("k"), "target").distinct()
    rank = F.row_number().over(Window.partitionBy("p", "k").orderBy("target"))
    put = put.withColumn("r", rank).where(F.col("r") <= FIELD_CAP)
    return _edges(senders.join(put, (F.col("path") == F.col("p")) & (F.col("key") == F.col("k"))), "observer")


def event_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """From senders of an event to its handlers, by the event's name; names with many of either are too general."""
    senders = placed(found.where("role = 'emit'"), nodes).where("scope is not null").select("key", F.col("scope").alias("source"), "line").distinct()
    handlers = _named(found.where("role = 'on'"), nodes).select("key", "target").distinct()
    few_s = senders.groupBy("key").agg(F.countDistinct("source").alias("n")).where(F.col("n") <= EVENT_CAP).select("key")
    few_h = handlers.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= EVENT_CAP).select("key")
    return _edges(senders.join(few_s, "key", "left_semi").join(few_h, "key", "left_semi").join(handlers, "key"), "event-emitter")


def pointer_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """C: from calls through a field to the functions stored in fields of that name, at most FIELD_CAP per field."""
    calls = placed(found.where("role = 'pointer-call'"), nodes).where("scope is not null").select("key", F.col("scope").alias("source"), "line").distinct()
    stored = _named(found.where("role = 'pointer-set'"), nodes).select("key", "target").distinct()
    few = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FIELD_CAP).select("key")
    return _edges(calls.join(few, "key", "left_semi").join(stored, "key"), "function-pointer")


def request_type_routes(nodes: DataFrame, marker: str = "goframe-route:") -> DataFrame:
    """Go: from routes whose qualified name ends in a request type to the method that takes a pointer to it.

    A handler in the route's own folder is preferred, then the least id.
    """
    routes = nodes.where((F.col("kind") == "route") & (F.col("language") == "go") & F.col("qualified_name").contains(marker))
    routes = routes.select(F.col("id").alias("source"), F.col("file_path").alias("r_path"), F.col("start_line").alias("line"), F.substring_index("qualified_name", marker, -1).alias("key"))
    routes = routes.withColumn("bare", F.substring_index("key", ".", -1))
    takes = nodes.where("kind = 'method' and language = 'go' and signature is not null")
    takes = takes.select(F.col("id").alias("target"), F.col("file_path").alias("h_path"), F.explode(F.regexp_extract_all("signature", F.lit(r"\*([\w.]+)"), F.lit(1))).alias("type"))
    takes = takes.withColumn("t_bare", F.substring_index("type", ".", -1)).distinct()
    met = routes.join(takes, F.col("bare") == F.col("t_bare"))
    order = F.struct((F.col("type") != F.col("key")).alias("a"), (directory(F.col("r_path")) != directory(F.col("h_path"))).alias("b"), F.col("target"))
    return _edges(met.groupBy("source", "key", "line").agg(F.min_by("target", order).alias("target")), "request-type")
