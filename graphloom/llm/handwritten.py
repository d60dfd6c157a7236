"""Files nobody wrote by hand: generated, minified, vendored, data kept as code (problem 5).

A Re-Pair grammar over the token sequences of paths carries the evidence.  It
starts from seed rules that spell published names of generators, bundlers and
package folders, and goes on with every pair of symbols that recurs.  A file is
known by the rules its derivation uses: a seed tells its kind; a rule that many
flagged files use tells generated files, one that files with known third-party
content use in several repositories tells vendoring.  Flags, known content and
size against symbols are proof by themselves.  The same grammars over the tokens
of source texts give rule reuse, incompressible literals and rules shared across
collections.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.repair import SEP, derivation, derive, infer, infer_symbol_rules, ordered_levels, rule_symbol, sequences, token_symbol
from graphloom.runtime import bounded, staged

# Folders that package managers and common practice keep third-party copies in.
VENDOR_FOLDERS = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party",
    "pods", "checkouts", "site-packages", "dist-packages", "deps", "external", "externals", "_vendor", "godeps", "elm-stuff", "web_modules", "extern",
)
# Folders that code generators write to.
GENERATED_FOLDERS = ("generated", "__generated__", "generated-sources", "generated-src", "generated-test-sources", "gen-src", "autogen", "_generated")
# What generators put before an extension of their output, and what they end names of one language with.
GENERATED_INFIXES = (".pb", "_pb", "_pb2", "_pb2_grpc", "_grpc_pb", ".grpc.pb", ".pb.validate", ".pb.gw", ".g", ".g.i", ".freezed", ".gr", ".gen", ".generated", "-generated", "_generated", ".designer", ".mocks", ".chopper", ".swagger")
GENERATED_ENDS = (
    ".pb-c.c", ".pb-c.h", ".config.dart", ".tab.c", ".tab.h", ".tab.cc", ".tab.cpp", ".tab.hh", ".yy.c", ".yy.h", ".yy.cc", ".yy.cpp", "_gen.go", "_gen.rs", "_string.go", "_mock.go", "_grpc.pb.go",
    "outer class.java", "grpc.java",
)
# Beginnings of generated names, with the extensions they are known for.
GENERATED_STARTS = (("zz_generated", ""), ("_generated", ""), ("autogenerated", ""), ("mock_", ".go"), ("wire_gen", ".go"), ("bindata", ".go"), ("moc_", ".cpp"), ("moc_", ".cc"), ("qrc_", ".cpp"), ("ui_", ".h"), ("ui_", ".cpp"), ("lex.", ".c"))
# What minifiers and bundlers put before the extension of a script; # stands for a content hash.
MINIFIED_INFIXES = (".min", "-min", ".bundle", "-bundle", ".bundled", ".packed", "-packed", ".compiled", ".chunk", ".prod", ".#", "-#", ".umd", ".esm", ".iife", ".amd", ".cjs")
BUNDLE_FORMATS, BUNDLE_STAGES = (".umd", ".esm", ".iife", ".amd", ".cjs"), (".prod", ".production", ".dev", ".development", ".min")
SCRIPT_EXTENSIONS = (".js", ".mjs", ".cjs", ".css")
SOURCE_EXTENSIONS = (
    ".py", ".pyi", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx", ".d.ts", ".ets", ".go", ".java", ".kt", ".cs", ".c", ".h", ".cc", ".cpp", ".hh", ".hpp", ".rs", ".rb", ".php",
    ".dart", ".swift", ".scala", ".vue", ".m",
)

#: Data kept as code: at least so many bytes and at most one symbol for so many bytes; without a count, so many bytes.
BLOB_BYTES, BLOB_BYTES_PER_SYMBOL, BLOB_BYTES_UNCOUNTED = 200_000, 40_000, 1_000_000

#: Kinds that rules tell, in the order in which they win.
RULE_KINDS = ("vendored", "generated", "minified")
_MARKS = "._-([^"
_CAMEL = regex.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_TOKEN = regex.compile(r"[a-z]+\d*|\d+|[^\sa-z0-9]")
_HASH = regex.compile(r"(?<=[.-])(?=[0-9a-f]*\d)[0-9a-f]{6,32}(?=[.-])")


def plain_path(path: str) -> str:
    return path.replace("\\", "/")


def _name_tokens(name: str) -> list[str]:
    return _TOKEN.findall(_CAMEL.sub(" ", _HASH.sub("#", name)).lower())


def path_tokens(path: str) -> list[str]:
    """A path as tokens: each folder below the repository after ( or, the last one, after [, then the words and marks of the name between ^ and $."""
    *folders, name = plain_path(path).split("/")
    out = [t for f in folders[1:] for t in ("(", f.lower())]
    if out:
        out[-2] = "["
    return [*out, "^", *_name_tokens(name), "$"]


@lru_cache(maxsize=1)
def seed_grammar() -> tuple[list[set[tuple[str, str]]], dict[tuple[str, ...], str]]:
    """(levels of rules that spell the published names, kind told by each rule or pair of rules used together)."""
    levels: list[set[tuple[str, str]]] = []
    kinds: dict[tuple[str, ...], str] = {}

    def spell(tokens: list[str]) -> str:
        """A mark and the word after it first, then from left to right."""

        def rule(level: int, a: str, b: str) -> str:
            levels.extend(set() for _ in range(level + 1 - len(levels)))
            levels[level].add((a, b))
            return a + SEP + b

        units, i = [], 0
        while i < len(tokens):
            if tokens[i] in _MARKS and i + 1 < len(tokens) and tokens[i + 1] not in _MARKS:
                units.append(rule(0, tokens[i], tokens[i + 1]))
                i += 2
            else:
                units.append(tokens[i])
                i += 1
        whole = units[0]
        for level, unit in enumerate(units[1:], 1):
            whole = rule(level, whole, unit)
        return whole

    def text(*parts: str) -> str:
        return spell([t for p in parts for t in _TOKEN.findall(p)])

    for folder in VENDOR_FOLDERS:
        kinds[(spell(["(", folder]),)] = "vendored"
    for folder in GENERATED_FOLDERS:
        kinds |= {(spell([mark, folder]),): "generated" for mark in "(["}
    for built in ("debug", "release"):
        kinds |= {(spell(["(", "obj", mark, built]),): "generated" for mark in "(["}
    for infix in GENERATED_INFIXES:
        kinds |= {(text(infix, e),): "generated" for e in SOURCE_EXTENSIONS}
    kinds |= {(text(end),): "generated" for end in GENERATED_ENDS}
    for start, extension in GENERATED_STARTS:
        kinds[(text("^", start), *([text(extension)] if extension else []))] = "generated"
    for infix in MINIFIED_INFIXES:
        kinds |= {(text(infix, e),): "minified" for e in SCRIPT_EXTENSIONS}
    for form in BUNDLE_FORMATS:
        kinds |= {(text(form, stage),): "minified" for stage in BUNDLE_STAGES}
    return levels, kinds


def marker_kind(path: str) -> str | None:
    """The kind that the seed rules alone give a path, or None."""
    levels, kinds = seed_grammar()
    used = derive(path_tokens(path), levels)[1]
    told = {kind for rules, kind in kinds.items() if used.issuperset(rules)}
    return next((k for k in RULE_KINDS if k in told), None)


def _symbol(name: str) -> int:
    """The symbol of a token or of a seed rule's name."""
    return _seed_symbols()[name] if SEP in name else token_symbol(name)


@lru_cache(maxsize=1)
def _seed_symbols() -> dict[str, int]:
    known: dict[str, int] = {}
    for level in seed_grammar()[0]:
        known |= {a + SEP + b: rule_symbol(*(known[x] if SEP in x else token_symbol(x) for x in (a, b))) for a, b in level}
    return known


def _lower_bound(hits: Column, n: Column, z: float = 4.0) -> Column:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit_path_rules(files: DataFrame) -> tuple[list[np.ndarray], dict[int, str]]:
    """(levels of the grammar, kind of each rule that was learned to tell one) from rows (s, repository, flagged, known).

    A rule tells "generated" if its share of flagged files lies surely above three
    times the overall share, "vendored" likewise for known content in two
    repositories or more.  All rows count; the driver holds the grammar and a row
    per telling rule.
    """
    names = {n: _symbol(n) for level in seed_grammar()[0] for pair in level for n in pair}
    seeds = [{(names[a], names[b]) for a, b in level} for level in seed_grammar()[0]]
    levels = ordered_levels(infer_symbol_rules(files, "s", seeds))
    shared = files.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rule = derivation(*sequences(batch.column(0)), shared.value)
            repository, flagged, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            ids, to = np.unique(rule, return_inverse=True)
            known = known.astype(bool)
            sums = [np.bincount(to, weights=w, minlength=len(ids)).astype(np.int64) for w in (np.ones(len(row)), flagged[row].astype(float), known[row].astype(float))]
            ends = [np.full(len(ids), x, np.int64) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min)]
            where = known[row]
            np.minimum.at(ends[0], to[where], repository[row][where])
            np.maximum.at(ends[1], to[where], repository[row][where])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *sums, *ends)], names=["rule", "n", "flagged", "known", "lo", "hi"])

    totals = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("flagged").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("known").cast("long")), F.lit(0))).first()
    n, flagged, known = totals
    if not n:
        return levels, {}
    stats = (
        files.select("s", "repository", "flagged", "known")
        .mapInArrow(run, "rule long, n long, flagged long, known long, lo long, hi long")
        .groupBy("rule")
        .agg(*[F.sum(c).alias(c) for c in ("n", "flagged", "known")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    generated = (F.col("flagged") > 0) & (_lower_bound(F.col("flagged"), F.col("n")) > max(3 * flagged / n, 0.1))
    vendored = (F.col("known") > 0) & (F.col("lo") < F.col("hi")) & (_lower_bound(F.col("known"), F.col("n")) > max(3 * known / n, 0.1))
    telling = stats.select("rule", F.when(generated, "generated").when(vendored, "vendored").alias("kind")).where("kind is not null")
    return levels, {r["rule"]: r["kind"] for r in telling.collect()}


def told_kinds(column: pa.Array, levels: list[np.ndarray], learned: dict[int, str], seeds: bool = True) -> list[str | None]:
    """The kind that the rules used by each sequence tell, or None; ``seeds`` off leaves the learned rules."""
    row, rule = derivation(*sequences(column), levels)
    best = np.full(len(column), len(RULE_KINDS))

    def tell(rows: np.ndarray, kind: str) -> None:
        best[rows] = np.minimum(best[rows], RULE_KINDS.index(kind))

    by_kind: dict[str, set[int]] = {}
    for symbol, kind in learned.items():
        by_kind.setdefault(kind, set()).add(symbol)
    if seeds:
        names = _seed_symbols()
        for rules, kind in seed_grammar()[1].items():
            if len(rules) == 1:
                by_kind.setdefault(kind, set()).add(names[rules[0]])
            else:
                tell(np.intersect1d(*(row[rule == names[r]] for r in rules)), kind)
    for kind, symbols in by_kind.items():
        tell(row[np.isin(rule, np.array(sorted(symbols), np.int64))], kind)
    return [RULE_KINDS[k] if k < len(RULE_KINDS) else None for k in best]


def machine_made(files: DataFrame, known: DataFrame, path: str = "path", hash_column: str = "content_hash", seeds: bool = True) -> DataFrame:
    """(path, kind) for rows of ``files`` (one per path) that nobody wrote by hand.

    ``files`` has path, content_hash, generated, size and node_count; ``known``
    has the content_hash of third-party files.  kind is flagged (a true flag),
    copied (known content), what the rules of the path tell (vendored, generated,
    minified), or data.  A false or null flag, null size and null hash prove
    nothing.  Rows with a null path are left out.
    """
    rows = files.select(
        F.col(path).alias("path"), F.col(hash_column).alias("content_hash"), F.col("generated"), F.col("size"), F.col("node_count")
    ).where("path is not null")
    hashes = known.select(F.col(hash_column).alias("known_hash")).where("known_hash is not null").distinct()
    if bounded(hashes):
        hashes = F.broadcast(hashes)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = [[token_symbol(t) for t in path_tokens(p)] for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(symbols, pa.list_(pa.int64()))], names=[*batch.schema.names, "s"])

    per_symbol = F.col("size") / F.greatest(F.col("node_count"), F.lit(1))
    blob = ((F.col("size") >= BLOB_BYTES) & (per_symbol >= BLOB_BYTES_PER_SYMBOL)) | (
        F.col("node_count").isNull() & (F.col("size") >= BLOB_BYTES_UNCOUNTED)
    )
    marked = rows.join(hashes, F.col("content_hash") == F.col("known_hash"), "left").select(
        "path",
        F.xxhash64(F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", 1)).alias("repository"),
        F.coalesce("generated", F.lit(False)).alias("flagged"),
        F.col("known_hash").isNotNull().alias("known"),
        F.coalesce(blob, F.lit(False)).alias("blob"),
    )
    marked = staged(marked.mapInArrow(tokenise, "path string, repository long, flagged boolean, known boolean, blob boolean, s array<long>"), "paths")
    shared = files.sparkSession.sparkContext.broadcast(fit_path_rules(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, learned = shared.value
        for batch in batches:
            told = told_kinds(batch.column("s"), levels, learned, seeds)
            paths, flagged, known, blob = (batch.column(c).to_pylist() for c in ("path", "flagged", "known", "blob"))
            kinds = ["flagged" if f else "copied" if k else t or ("data" if b else None) for f, k, t, b in zip(flagged, known, told, blob)]
            kept = [(p, k) for p, k in zip(paths, kinds) if k]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.string()) for i in (0, 1)], names=["path", "kind"])

    return marked.select("path", "flagged", "known", "blob", "s").mapInArrow(run, "path string, kind string")


_CODE_TOKEN = regex.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\p{L}[\p{L}\p{N}_]*|\p{N}+|[^\s\p{L}\p{N}]")


def text_profile(text: str) -> tuple[int, float, float, list[str]]:
    """(tokens, share of tokens that rules explain, share of characters in long literals, rules of 8 tokens or more)."""
    tokens = _CODE_TOKEN.findall(text)
    left, uses = infer(tokens)
    explained = 1 - sum(1 for s in left if SEP not in s) / len(tokens) if tokens else 0.0
    literals = sum(len(t) for t in tokens if t[0] in "\"'" and len(t) >= 64)
    return len(tokens), explained, literals / max(1, len(text)), [r for r in uses if r.count(SEP) >= 7]


def text_profiles(df: DataFrame, id_column: str, text: str, group: str) -> DataFrame:
    """(id, tokens, reuse, literal_share, shared_rules): Re-Pair figures of source texts.

    shared_rules counts the text's rules of eight tokens or more that occur in
    another ``group`` (repository) too.  Null texts are left out; an empty text has
    no tokens and reuse 0; a null group is a group of its own.
    """
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(group).cast("string").alias("repository"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, repo, *text_profile(body)) for key, repo, body in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "repository", "tokens", "reuse", "literal_share", "rules"])

    profiles = staged(rows.mapInArrow(run, "id string, repository string, tokens long, reuse double, literal_share double, rules array<string>"), "profiles")
    uses = profiles.select("id", F.coalesce("repository", F.lit("")).alias("repository"), F.explode("rules").alias("rule")).withColumn("rule", F.xxhash64("rule"))
    shared = uses.groupBy("rule").agg(F.min("repository").alias("lo"), F.max("repository").alias("hi")).where("lo <> hi").select("rule")
    counts = uses.join(shared, "rule", "left_semi").groupBy(F.col("id").alias("uses_id")).agg(F.count(F.lit(1)).alias("shared_rules"))
    return profiles.join(counts, F.col("id") == F.col("uses_id"), "left").select(
        "id", "tokens", "reuse", "literal_share", F.coalesce("shared_rules", F.lit(0)).alias("shared_rules")
    )
