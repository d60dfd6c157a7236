"""Ranked text retrieval over symbols and documents."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.names import base_name, directory, is_test_file, kind_bonus, segments
from graphloom.operators.many import B, K1, SEP, best_by_bm25, pairs_by_terms
from graphloom.runtime import staged

#: Weights of a symbol's fields in BM25.
WEIGHTS = {"name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
# Words too common in prose, or about code rather than of it, to name a symbol.
PROSE_STOP_WORDS = frozenset(
    """about above actually after again against almost along also always another anything around away back because been before behind being below best better
    between both cannot come could does doing done down each either else even ever every everything fine first from getting give goes going gone good great have
    having help here inside instead into just keep know last least less like likely little look looking made make making many maybe mind more most much must need
    needs never next nice none nothing okay only onto other otherwise over please pretty probably quite rather really right same seem seems should show since some
    someone something somewhere soon still such sure take than thank thanks that their them then there these they thing things think this those though tried tries
    trying under until upon very want wants well went were what when which while will wish with within without would wrong your yours change changes check class
    classes code detail details directory error errors example examples file files folder function functions issue issues line lines method methods name names
    problem problems project question questions rename test tests type types update value values warning warnings work working write writing""".split()
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


# ---- queries ------------------------------------------------------------------------------------------------------


@dataclass
class ParsedQuery:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


NODE_KINDS = frozenset(
    "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component".split()
)


def parse_query(raw: str) -> ParsedQuery:
    """Splits ``kind:``, ``lang:``/``language:``, ``path:`` and ``name:`` filters from free text.

    Values may be quoted; an unknown field, an unknown kind or an empty value is text.
    """
    out, free = ParsedQuery(), []
    for whole, name, quoted, plain in re.findall(r'((?:(\w+):)?(?:"([^"]*)"|(\S+)))', raw or ""):
        value = quoted or plain
        slot = {"kind": out.kinds, "lang": out.languages, "language": out.languages, "path": out.paths, "name": out.names}.get(name.lower())
        if slot is None or not value or (slot is out.kinds and value.lower() not in NODE_KINDS):
            free.append(whole if name else value)
        else:
            slot.append(value.lower() if slot is not out.paths and slot is not out.names else value)
    out.text = " ".join(free)
    return out


def query_terms(text: str) -> list[str]:
    """Prefix terms of a free text: qualifiers split, operators and marks dropped, distinct, in lower case."""
    plain = re.sub(r"['\"*():^]", "", text.replace("::", " "))
    words = [w for t in plain.split() if t.upper() not in ("AND", "OR", "NOT", "NEAR") for w in re.findall(r"[^\W_]+", t.lower())]
    return list(dict.fromkeys(words))


def bounded_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


# ---- scoring ------------------------------------------------------------------------------------------------------


def first_of(rules: list[tuple[Column, Column | int]], otherwise: Column | int | None = 0) -> Column:
    """The value of the first rule (condition, value) that holds."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _parts(word: str) -> list[str]:
    """A word's pieces at marks and case changes, lower-cased, of two letters or more."""
    return [p.lower() for p in re.findall(r"(?:[A-Z]+|[^\W_A-Z])[^\W_A-Z]*", word) if len(p) >= 2]


def name_match_bonus(name: Column, query: str) -> Column:
    """What a name is worth for a query by the first rule of a table: equal, one of several words, beginning, all pieces inside, inside."""
    low, whole = F.lower(name), "".join(query.split()).lower()
    words = [w.lower() for w in query.split() if len(w) >= 2]
    pieces = [p for w in re.split(r"[\s_.\-]+", query) for p in _parts(w)]
    rules = [
        (low == whole, 80),
        (low.isin(words) if len(words) > 1 else F.lit(False), 60),
        (low.startswith(whole), F.round(10 + F.lit(30.0 * len(whole)) / F.length(low)).cast("int")),
        (F.forall(_texts(pieces), lambda p: F.contains(low, p)) if len(pieces) > 1 else F.lit(False), 15),
        (low.contains(whole), 10),
    ]
    return first_of(rules)


#: What a query's word is worth where a path holds a piece of it: the file counts by itself, of folder and whole path the better one.
FILE_HIT, FOLDER_HIT, PATH_HIT, TEST_PENALTY = 10, 5, 3, -15


def path_relevance(path: Column, query: str, project_words: frozenset[str] = frozenset()) -> Column:
    """The sum over a table of rules, two per word of the query, and a penalty for tests that were not asked for."""
    low = F.lower(path)

    def inside(place: Column, pieces: list[str]) -> Column:
        return F.exists(_texts(pieces), lambda p: F.contains(place, p))

    asked = [w for w in query.split() if re.sub(r"[\W_]+", "", w).lower() not in project_words] or query.split()
    table = [[(F.lit(bool(query) and not re.search("test|spec", query.lower())) & is_test_file(path), TEST_PENALTY)]]
    for pieces in (sorted({*_parts(w), *([w.lower()] if len(w) >= 2 else [])}) for w in asked):
        table += [[(inside(base_name(low), pieces), FILE_HIT)], [(inside(directory(low), pieces), FOLDER_HIT), (inside(low, pieces), PATH_HIT)]]
    return sum((first_of(rules) for rules in table), F.lit(0))


def rescored(hits: DataFrame, query: str, project_words: frozenset[str] = frozenset()) -> DataFrame:
    """``score`` plus what kind, path and name are worth for the query."""
    extra = kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), query, project_words) + name_match_bonus(F.col("name"), query)
    return hits.withColumn("score", F.col("score") + extra)


# ---- candidate tiers ----------------------------------------------------------------------------------------------


def filtered(nodes: DataFrame, kinds: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    if kinds:
        nodes = nodes.where(F.col("kind").isin(kinds))
    if languages:
        nodes = nodes.where(F.col("language").isin(languages))
    return nodes


def bm25(nodes: DataFrame, terms: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``nodes`` that hold a term by prefix in a weighted field, with ``score``.

    One pass over the rows gives row count, mean length and the number of rows
    per term; a second scores, all in generated code without a shuffle of rows.
    """
    fields = [f for f in weights if f in nodes.columns]
    tokenised = nodes.withColumns({f"__t_{f}": tokens(F.col(f)) for f in fields})
    length = sum((F.size(f"__t_{f}") for f in fields), F.lit(0))

    def freq(term: str) -> Column:
        parts = (F.lit(weights[f]) * F.size(F.filter(F.col(f"__t_{f}"), lambda t: t.startswith(term))) for f in fields)
        return sum(parts, F.lit(0.0))

    def found(term: str) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | F.exists(F.col(f"__t_{f}"), lambda t: t.startswith(term))
        return out

    stats = tokenised.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"), *[F.count_if(found(t)).alias(f"df{i}") for i, t in enumerate(terms)]).first()
    n, mean = stats["n"], max(stats["mean"] or 0.0, 1e-9)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        df = stats[f"df{i}"]
        idf = F.greatest(F.log(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(1e-6))
        f = freq(t)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
    return tokenised.withColumn("score", score).where("score > 0").drop(*[f"__t_{f}" for f in fields])


def like_tiers(nodes: DataFrame, text: str) -> DataFrame:
    """Substring matches: 1.0 exact, 0.9 prefix, 0.8 inside the name, 0.7 inside the qualified name."""
    low, name, qualified = text.lower(), F.lower("name"), F.lower("qualified_name")
    score = F.when(F.col("name") == text, 1.0).when(name.startswith(low), 0.9).when(name.contains(low), 0.8).when(qualified.contains(low), 0.7)
    return nodes.withColumn("score", score).where("score is not null")


def fuzzy_names(nodes: DataFrame, text: str, per_name: int = 5) -> DataFrame:
    """Nodes whose name is at most one (short texts) or two edits away; score 1 / (1 + edits).

    Distances are taken once per distinct name; ``per_name`` nodes are kept of each.
    """
    most = 1 if len(text) <= 4 else 2
    d = F.levenshtein(F.lower("near"), F.lit(text.lower()), most)
    near = nodes.select(F.col("name").alias("near")).distinct().withColumn("distance", d).where("distance >= 0")
    hits = nodes.join(near, F.col("name") == F.col("near"))
    w = Window.partitionBy("near").orderBy("file_path", "start_line", "id")
    return hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_name).withColumn("score", 1.0 / (1 + F.col("distance"))).drop("near", "__r")


def substring_lookup(nodes: DataFrame, text: str, skip_prefix: bool = False) -> DataFrame:
    low = F.lower("name")
    hits = nodes.where(low.contains(text.lower()))
    return hits.where(~low.startswith(text.lower())) if skip_prefix else hits


def exact_names(nodes: DataFrame, names: list[str], rare_files: int = 10) -> DataFrame:
    """Nodes of the names (case aside) with score 1, and 20 more in files that hold a distinctive one.

    A name is distinctive if fewer than ``rare_files`` files define it.
    """
    low = F.lower("name")
    hits = nodes.where(low.isin([n.lower() for n in names])).withColumn("__low", low)
    rare = hits.groupBy("__low").agg(F.countDistinct("file_path").alias("n_files")).where(F.col("n_files") < rare_files).select("__low")
    good = hits.join(rare, "__low", "left_semi").select(F.col("file_path").alias("__file")).distinct()
    marked = hits.join(good.withColumn("__hit", F.lit(20.0)), F.col("file_path") == F.col("__file"), "left")
    others = Window.partitionBy("file_path")
    both = F.size(F.collect_set("__low").over(others)) > 1
    return marked.withColumn("score", F.lit(1.0) + F.when(both, F.coalesce("__hit", F.lit(0.0))).otherwise(0.0)).drop("__low", "__file", "__hit")


def top(hits: DataFrame, k: int, *by: Column) -> DataFrame:
    return hits.orderBy(*by, "id").limit(k)


def search(nodes: DataFrame, raw: str, limit: int = 100, project_words: frozenset[str] = frozenset(), attached: DataFrame | None = None) -> DataFrame:
    """Ranked symbols for a query with filters: (node columns, score).

    BM25 by prefix, else substrings, else near spellings; exact names join at the
    best score; then kind, path and name count, the best ``limit`` stay, and path and
    name filters apply to these.  Symbols of an attached graph follow at 0.9.
    """
    q = parse_query(raw)
    pool = filtered(nodes, q.kinds, q.languages)
    terms = query_terms(q.text)
    if not q.text:
        hits = top(pool.withColumn("score", F.lit(1.0)), limit * 5, F.col("name"))
    else:
        hits = top(bm25(pool, terms), max(limit * 5, 100), F.desc("score")) if terms else pool.withColumn("score", F.lit(0.0)).limit(0)
        if hits.isEmpty() and len(q.text) >= 2:
            hits = top(like_tiers(pool, q.text), limit, F.desc("score"), F.length("name"))
            if hits.isEmpty() and len(q.text) >= 3:
                hits = top(fuzzy_names(pool, q.text).drop("distance"), max(2 * limit, 50), F.desc("score"))
        best = hits.agg(F.max("score").alias("__best"))
        words = [t.lower() for t in raw.split() if len(t) >= 2]
        exact = pool.where(F.lower("name").isin(words))
        w = Window.partitionBy(F.lower("name")).orderBy("file_path", "start_line", "id")
        exact = exact.withColumn("__r", F.row_number().over(w)).where("__r <= 20").drop("__r")
        more = exact.join(hits.select("id"), "id", "left_anti").crossJoin(F.broadcast(best)).where("__best is not null").withColumnRenamed("__best", "score")
        hits = hits.unionByName(more)
    out = top(rescored(hits, q.text or raw, project_words), limit, F.desc("score"))
    for column, wanted in (("file_path", q.paths), ("name", q.names)):
        if wanted:
            low, keep = F.lower(column), F.lit(False)
            for x in wanted:
                keep = keep | low.contains(x.lower())
            out = out.where(keep)
    if attached is not None and q.text:
        extra = like_tiers(filtered(attached, q.kinds, q.languages), q.text).withColumn("score", F.lit(0.9))
        extra = top(extra, min(max(limit // 4, 5), 20), F.length("name")).join(out.select("id"), "id", "left_anti")
        out = out.unionByName(extra, allowMissingColumns=True)
    return out


# ---- many queries at once -----------------------------------------------------------------------------------------


def postings(df: DataFrame, id_column: str, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """((id, length, terms, weights), (id, length)): the terms of each row with the weights of their fields, and row lengths."""
    rows = df.select(F.col(id_column).alias("id"), *[tokens(F.col(f)).alias(f) for f in weights])
    length = sum((F.size(f) for f in weights), F.lit(0)).alias("length")
    weighted = F.concat(*[F.array_repeat(F.lit(float(w)), F.size(f)) for f, w in weights.items()])
    return rows.select("id", length, F.concat(*weights).alias("terms"), weighted.alias("weights")), rows.select("id", length)


def bm25_many(post: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 10, prefix: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` rows for each query; ``queries`` has query_id and term.

    Distinct queries are broadcast in blocks and every row is scored for all of
    them where it lies; a task hands on its best ``k`` rows for each query, so no
    pair of row and query is shuffled.
    """
    return best_by_bm25(post, lengths, queries, k, prefix)


def top_per_key(df: DataFrame, key: str, k: int, *order: Column, parts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``; ranked in parts first, so a hot key is no single task's."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(parts))
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy(key, salt).orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


# ---- segment vocabulary -------------------------------------------------------------------------------------------


def segment_vocabulary(nodes: DataFrame) -> DataFrame:
    """(segment, name): which words the symbol names are made of."""
    return nodes.select("name").distinct().select(F.explode(segments(F.col("name"))).alias("segment"), "name").distinct()


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Decomposed, marks removed, lower case."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M").lower())


def prose_words(text: Column, most: int | None = None) -> Column:
    """Distinct words of a text that might name a symbol: 4 to 24 characters, no stop words, not of digits only."""
    words = F.regexp_extract_all(without_marks(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    good = F.filter(words, lambda w: (F.length(w) >= 4) & (F.length(w) <= 24) & ~w.rlike(r"^\p{N}+$") & ~w.isin(*sorted(PROSE_STOP_WORDS)))
    out = F.array_distinct(good)
    return F.slice(out, 1, most) if most else out


# Endings of plurals, with the numbers of letters that may be cut off.
PLURALS = ((r"(x|sh|ss|zz)es$", (2,)), (r"(ch|s|z|o)es$", (2, 1)), (r"[^s]s$", (1,)))


def word_variants(word: Column) -> Column:
    """The word and its possible singulars, of four letters or more, by the first ending that fits."""
    cuts = first_of([(word.rlike(ending), F.array(*map(F.lit, n))) for ending, n in PLURALS], F.array().cast("array<int>"))
    shorter = F.transform(cuts, lambda n: F.when(F.length(word) - n >= 4, F.substring(word, F.lit(1), F.length(word) - n)))
    return F.array_compact(F.concat(F.array(word), shorter))


def segment_matches(vocabulary: DataFrame, asked: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, name, n_words): names in which ``least`` different words of a query occur; ``asked`` has query_id and word."""
    spellings = F.collect_set(F.array_join(word_variants(F.col("word")), SEP))
    queries = staged(asked.where("word is not null").groupBy("query_id").agg(spellings.alias("spellings")), "asked")
    return pairs_by_terms(vocabulary.groupBy("name").agg(F.collect_set("segment").alias("terms")), queries, least)
