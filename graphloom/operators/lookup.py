"""What stands around a search: terms of questions, rarity of words, specs by words, and small summaries of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import low_value_file, segments
from graphloom.operators.text import bm25, first_of, query_terms, tokens, top_per_key, word_variants

# Words of a question that name nothing.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each every how what where when who "
    "which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such over only out its so up as if look need needs want "
    "happen happens affect affected break breaks failing implemented implement code file files function method class type fix bug called"
).split()
# Endings by which words are cut to stems: ending, shortest word, then letters to drop and text to add for each stem.
STEMS = (
    ("ing", 6, ((3, ""), (3, "e"))), ("tion", 6, ((3, ""),)), ("sion", 6, ((3, ""),)), ("ment", 7, ((4, ""),)), ("ies", 5, ((3, "y"),)), ("es", 5, ((2, ""),)), ("s", 5, ((1, ""),)),
    ("ed", 5, ((1, ""), (2, ""))), ("ied", 6, ((3, "y"),)), ("er", 5, ((2, ""), (2, "e"))),
)
#: Of these groups of endings only the first that fits counts; after these endings a doubled consonant may be one; these endings are none.
ONE_OF, UNDOUBLED, NO_ENDING = (("ies", "es", "s"),), ("ing", "er"), {"s": "ss", "ed": "eed"}


def stem_variants(word: Column) -> Column:
    """Possible stems of a word of three letters or more, by the table of endings; without the word itself."""
    low = F.lower(word)

    def fits(ending: str, least: int) -> Column:
        ok = low.endswith(ending) & (F.length(low) >= least)
        if ending in NO_ENDING:
            ok = ok & ~low.endswith(NO_ENDING[ending])
        for group in ONE_OF:
            for earlier in group[: group.index(ending)] if ending in group else ():
                ok = ok & ~low.endswith(earlier)
        return ok

    found = []
    for ending, least, cuts in STEMS:
        bases = [F.concat(F.substring(low, F.lit(1), F.length(low) - n), F.lit(more)) for n, more in cuts]
        if ending in UNDOUBLED:
            base = bases[0]
            bases.append(F.when(F.substring(base, -1, 1) == F.substring(base, -2, 1), F.substring(base, F.lit(1), F.length(base) - 1)))
        found.append(F.when(fits(ending, least), F.array(*bases)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.array_compact(F.concat(*found))), lambda s: (F.length(s) >= 3) & (s != low))


def distinctive(token: Column) -> Column:
    """Whether a token can only be an identifier: a digit, an underscore, or a capital after the first letter."""
    return F.coalesce(token.rlike(r"[_0-9]|^.[^A-Z]*[A-Z]"), F.lit(False))


def question_terms(text: Column, stems: bool = True) -> Column:
    """Terms of a question: compounds as they stand, their pieces, other words without stop words, and stems of all."""

    def every(pattern: str, of: Column) -> Column:
        return F.coalesce(F.regexp_extract_all(of, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))

    compounds = F.filter(F.concat(every(r"[A-Za-z][A-Za-z0-9]*(?:[._][A-Za-z0-9]+)+", text), every(r"[A-Za-z][A-Za-z0-9_]*", text)), lambda t: distinctive(t) | t.contains("."))
    cut = F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.transform(every(r"[A-Za-z0-9]+", cut), lambda w: F.lower(w)), lambda w: ~w.isin(*STOP_WORDS))
    whole = F.array_distinct(F.filter(F.concat(F.transform(compounds, lambda c: F.lower(c)), words), lambda w: F.length(w) >= 3))
    if not stems:
        return whole
    grown = F.filter(F.flatten(F.transform(whole, stem_variants)), lambda w: ~w.isin(*STOP_WORDS))
    return F.array_union(whole, grown)


def rare_words(vocabulary: DataFrame, asked: DataFrame, answered: DataFrame, most: int = 25, words: int = 2, names: int = 12) -> DataFrame:
    """(query_id, word, segment, name): for queries not ``answered`` (query_id) the names that hold one of their rarest words.

    A word has five letters or more, its segment stands in 2 to ``most`` names, the
    ``words`` rarest count, and a name has two segments or more.  ``vocabulary`` has
    segment and name, ``asked`` query_id and word.
    """
    open_ = asked.where(F.length("word") >= 5).join(answered.select("query_id").distinct(), "query_id", "left_anti")
    wanted = open_.select("query_id", "word", F.explode(word_variants(F.col("word"))).alias("segment")).distinct()
    few = vocabulary.groupBy("segment").agg(F.count(F.lit(1)).alias("n_names")).where(F.col("n_names").between(2, most))
    rarest = top_per_key(wanted.join(few, "segment"), "query_id", words, F.col("n_names"), F.col("segment"), F.col("word")).drop("rank")
    held = vocabulary.join(few.select("segment"), "segment", "left_semi").where(F.size(segments(F.col("name"))) >= 2)  # at most ``most`` names a segment
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("segment").orderBy(F.length("name"), "name"))).where(F.col("r") <= names)
    return rarest.join(ranked, "segment").select("query_id", "word", "segment", "name")


def search_specs(specs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, title, score, method) of specs (id, title, body, ts_ms) for a query, in three stages.

    All words of the query in title or body, the better by their rank and then by
    what the title is worth; then titles and bodies that hold the query as it stands;
    when nothing is found the newest.  A blank query lists specs by id.
    """
    low, title = query.strip().lower(), F.lower(F.coalesce("title", F.lit("")))
    if not low:
        return specs.orderBy("id").limit(limit).select("id", "title", F.lit(0.0).alias("score"), F.lit("all").alias("method"))
    worth = first_of([(title == low, 3.0), (title.startswith(low), 2.5), (title.contains(low), 2.0)], 1.0)
    terms = query_terms(query)
    has = tokens(F.concat_ws(" ", "title", "body"))
    whole = specs.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(has, t))) if terms else specs.limit(0)
    ranked = bm25(whole, terms, {"title": 3.0, "body": 1.0}).orderBy(F.desc("score"), "id").limit(3 * limit) if terms else whole.withColumn("score", F.lit(0.0))
    first = ranked.withColumn("score", worth).orderBy(F.desc("score"), "id").limit(limit)
    inside = specs.where(title.contains(low) | F.lower("body").contains(low)).join(first.select("id"), "id", "left_anti")
    second = inside.withColumn("score", first_of([(title == low, 3.0), (title.startswith(low), 2.5), (title.contains(low), 2.0)], 0.5)).orderBy(F.desc("score"), "id").limit(limit)
    both = first.select("id", "title", "score", F.lit("words").alias("method")).unionByName(second.select("id", "title", "score", F.lit("inside").alias("method")))
    found = both.orderBy(F.desc("score"), "id").limit(limit)
    if not found.isEmpty():
        return found
    return specs.orderBy(F.desc("ts_ms"), "id").limit(limit).select("id", "title", F.lit(0.0).alias("score"), F.lit("newest").alias("method"))


def capped_per_name(hits: DataFrame, limit: int, n_names: int, *order: Column) -> DataFrame:
    """At most max(8, limit / n_names) hits of each name, the best first (the cap is the feature: one name must not fill a list)."""
    cap = max(8, -(-limit // max(1, n_names)))
    return top_per_key(hits.withColumn("__name", F.lower("name")), "__name", cap, *order).drop("__name", "rank")


def definition_groups(nodes: DataFrame) -> DataFrame:
    """(name, n_rows, n_groups): symbols of a name, and how many definitions (file and qualified name) they make."""
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct("file_path", "qualified_name")).alias("n_groups"))


def top_route_file(nodes: DataFrame, least: int = 3, share: float = 0.3, among: int = 20) -> DataFrame:
    """(file_path, n_routes, total): the production file with most routes, if it has ``least`` and its ``share`` of those of the first files."""
    per = nodes.where("kind = 'route'").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_routes"))
    kept = per.orderBy(F.desc("n_routes"), "file_path").limit(among).where(~low_value_file(F.col("file_path")))
    whole = kept.withColumn("total", F.sum("n_routes").over(Window.partitionBy(F.lit(0))))  # at most ``among`` rows
    return whole.orderBy(F.desc("n_routes"), "file_path").limit(1).where((F.col("n_routes") >= least) & (F.col("total") >= least) & (F.col("n_routes") / F.col("total") >= share))


def main_handler_file(manifest: DataFrame) -> DataFrame:
    """(handler_file, n_handlers): the production file that holds most handlers of a route manifest."""
    per = manifest.where(~low_value_file(F.col("handler_file"))).groupBy("handler_file").agg(F.count(F.lit(1)).alias("n_handlers"))
    return per.orderBy(F.desc("n_handlers"), "handler_file").limit(1)


def directory_rollup(files: DataFrame) -> DataFrame:
    """(folder, depth, n_files, bytes): every folder with the files anywhere below it."""
    parts = F.split("path", "/")
    level = F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")))
    each = files.where("path is not null").select("path", "size", level.alias("depth"))
    return each.groupBy(F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth")), "/").alias("folder"), "depth").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def config_leaf(kind: Column, language: Column) -> Column:
    """Whether a symbol is a key lifted out of a configuration file, whose line holds a value that may be secret."""
    return F.coalesce((kind == "constant") & language.isin("yaml", "properties"), F.lit(False))


def without_values(nodes: DataFrame) -> DataFrame:
    """Nodes without the texts that could show a configuration value."""
    leaf = config_leaf(F.col("kind"), F.col("language"))
    return nodes.withColumns({c: F.when(~leaf, F.col(c)) for c in ("signature", "docstring") if c in nodes.columns})


def probes(name: Column) -> Column:
    """The names a reference may stand for: itself, its pieces, and its receiver with a capital."""
    pieces = F.filter(F.split(name, r"[.:$/>\-]+"), lambda p: p != "")
    receiver = F.element_at(pieces, 1)
    capital = F.concat(F.upper(F.substring(receiver, 1, 1)), F.substring(receiver, F.lit(2), F.length(receiver)))
    return F.array_distinct(F.concat(F.array(name), pieces, F.when(F.size(pieces) > 1, F.array(capital)).otherwise(F.array().cast("array<string>"))))


def answerable(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of which some probe names a symbol; the others leave before any strategy looks at them. Imports always stay."""
    names = nodes.select(F.col("name").alias("probe")).distinct()
    keys = refs.where("reference_kind <> 'imports'").select("reference_name").distinct()
    hit = keys.select("reference_name", F.explode(probes(F.col("reference_name"))).alias("probe")).join(names, "probe", "left_semi").select("reference_name").distinct()
    return refs.where("reference_kind = 'imports'").unionByName(refs.where("reference_kind <> 'imports'").join(hit, "reference_name", "left_semi").select(*refs.columns))


def without_builtins(refs: DataFrame, builtins: DataFrame) -> DataFrame:
    """References that name no built-in of their language; ``builtins`` has language and name, and names a bare call or the receiver of one."""
    known = builtins.select(F.col("language").alias("b_language"), F.col("name").alias("b_name")).distinct()
    head = F.regexp_extract("reference_name", r"^([^.:>]*)", 1)
    return refs.withColumn("__head", head).join(known, (F.col("ref_language") == F.col("b_language")) & (F.col("__head") == F.col("b_name")), "left_anti").drop("__head")


# Built-in names of some languages, as the default table of ``without_builtins``.
BUILTINS = {
    "python": "print len range str int float list dict set tuple bool open isinstance getattr setattr hasattr super type map filter zip enumerate sorted sum min max abs any all repr iter next id hash vars",
    "javascript": "console Math JSON Object Array String Number Boolean Promise Date RegExp Map Set Symbol Error parseInt parseFloat setTimeout setInterval clearTimeout require module process window document",
    "go": "append cap close copy delete len make new panic print println recover fmt strings strconv errors os io sync time context",
}


def default_builtins(spark) -> DataFrame:
    rows = [(g, w) for language, words in BUILTINS.items() for g in ({"javascript": ("javascript", "typescript", "jsx", "tsx")}.get(language, (language,))) for w in words.split()]
    return spark.createDataFrame(rows, "language string, name string")
