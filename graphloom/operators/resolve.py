"""Resolving name references into edges: candidate strategies, scores, rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import LANGUAGE_FAMILY, base_name, folder_parts, map_of, plain_kind, plain_language, plain_path, shared_directories
from graphloom.runtime import bounded, staged

#: More candidates than this for one name: the reference is left unresolved where a ceiling is asked for.
CEILING = 500
#: A reference with at most so many candidates is compared with each of them, others with the best of each folder.
DIRECT = 500
#: Leading folders that count for nearness.
FOLDERS = 6
#: Characters before a reference's last name that a symbol must share before the two are compared.
SUFFIX = 4
#: Hashes of asked keys that are broadcast to filter the other side of a join before it is shuffled.
FILTER_ROWS = 2_000_000


def _asked_for(rows: DataFrame, keys: tuple, asked: DataFrame, asked_keys: tuple) -> DataFrame:
    """``rows`` without most of those whose keys nobody asks for: a filter before a join, by hashes where they are few enough; else all rows."""
    hashes = asked.select(F.xxhash64(*asked_keys).alias("__h")).distinct()
    if not bounded(hashes, FILTER_ROWS):
        return rows
    return rows.join(F.broadcast(hashes), F.xxhash64(*keys) == F.col("__h"), "left_semi")


def clean_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with even spelling: one row per (from, name, kind, line, col), blank files taken from the referring node, tails filled in."""
    rows = refs.select(
        "id", "from_node_id", "reference_name", plain_kind(F.col("reference_kind")).alias("reference_kind"), "line", "col",
        plain_path(F.col("file_path")).alias("file_path"), plain_language(F.col("language")).alias("language"), "status",
    ).where("reference_name is not null and trim(reference_name) <> ''")
    keys = ["from_node_id", "reference_name", "reference_kind", "line", "col"]
    one = rows.groupBy(*keys).agg(F.min(F.struct("id", "file_path", "language", "status")).alias("r")).select(*keys, "r.*")
    # Only blank files and unknown languages are looked up.
    open_ = (F.trim(F.coalesce("file_path", F.lit(""))) == "") | (F.col("language") == "unknown")
    blank = rows.where(open_).select(F.col("from_node_id").alias("b_id")).distinct()
    home = nodes.select(F.col("id").alias("h_id"), F.col("file_path").alias("h_path"), F.col("language").alias("h_language"))
    if bounded(blank):
        home = F.broadcast(home.join(F.broadcast(blank), F.col("h_id") == F.col("b_id"), "left_semi"))
    filled = one.join(home, F.col("from_node_id") == F.col("h_id"), "left")
    path = F.when(F.trim(F.coalesce("file_path", F.lit(""))) == "", F.col("h_path")).otherwise(F.col("file_path"))
    language = F.when(F.col("language") == "unknown", F.coalesce("h_language", "language")).otherwise(F.col("language"))
    return filled.select(
        F.col("id").alias("ref_id"), *keys[:3], F.col("line").alias("ref_line"), F.col("col").alias("ref_col"), path.alias("ref_path"), language.alias("ref_language"), "status",
        F.regexp_extract("reference_name", r"([^.:>]*)$", 1).alias("tail"),
    )


def family(language: Column) -> Column:
    return F.coalesce(map_of(LANGUAGE_FAMILY, language), language)


def _admitted(kind: Column, ref_language: Column, language: Column) -> Column:
    """Whether a candidate's language may answer: same family for values, no crossing of known families for imports."""
    known = map_of(LANGUAGE_FAMILY, ref_language).isNotNull() & map_of(LANGUAGE_FAMILY, language).isNotNull()
    same = family(ref_language) == family(language)
    return F.when(kind.isin("references", "function_ref"), same).when(kind == "imports", same | ~known).otherwise(F.lit(True))


def _fit() -> Column:
    """The part of a candidate's score that its file has no part in: language, kind, export."""
    kind, ref_kind = F.col("kind"), F.col("reference_kind")
    score = F.when(F.col("language") == F.col("ref_language"), 50).otherwise(-80)
    score = score + F.when(ref_kind.isin("calls", "decorates") & kind.isin("function", "method"), 25).when(
        (ref_kind == "instantiates") & kind.isin("class", "struct", "interface"), 25
    ).when((ref_kind == "decorates") & kind.isin("class", "interface"), 15).otherwise(0)
    return score + F.when(F.coalesce("is_exported", F.lit(False)), 10).otherwise(0)


def match_score() -> Column:
    """How well a candidate fits a reference: file, folders, language, kind, export, nearness."""
    same_file = F.col("file_path") == F.col("ref_path")
    score = F.when(same_file, 100).otherwise(0) + shared_directories(F.col("ref_path"), F.col("file_path")) + _fit()
    near = F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.col("ref_line")) / 10)
    return score + F.when(same_file, F.coalesce(near, F.lit(0.0))).otherwise(0.0)


def _best(candidates: DataFrame) -> DataFrame:
    """The best candidate per reference: greatest score, then file, line and id; combined in the map tasks."""
    order = F.struct((-F.col("score")).alias("s"), "file_path", "start_line", "id")
    return candidates.groupBy("ref_id").agg(F.min_by(F.struct("id", "file_path", "language", "kind", "ref_path", "ref_language"), order).alias("b"), F.max("total").alias("total")).select("ref_id", "total", "b.*")


def _by_folder(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with each of the leading ``folder``s of a path, 0 to FOLDERS of them (``depth``): what shared_directories compares."""
    folder, parts = folder_parts(F.col(path))
    each = rows.withColumn("__folder", folder).withColumn("depth", F.explode(F.sequence(F.lit(0), F.coalesce(F.least(parts, F.lit(FOLDERS)), F.lit(0)))))
    return each.withColumn("folder", F.coalesce(F.expr("substring_index(__folder, '/', depth)"), F.lit(""))).drop("__folder")


def _best_of_many(refs: DataFrame, pool: DataFrame) -> DataFrame:
    """``_best`` of references (with total and own) whose names very many symbols of ``pool`` have, without comparing each with each.

    Outside the reference's file a score depends on the folders in common and on
    language, kind and export, so the first symbol of each of these in each leading
    folder stands for all.  A symbol met in a folder farther out than need be scores
    too low there, never too high, and is met in the right one too; so do those of
    the reference's own file, which are compared one by one.
    """
    pool = pool.orderBy("file_path", "start_line", "id").withColumn("rank", F.monotonically_increasing_id())
    pool = staged(pool.select("id", "name", "kind", "file_path", "language", "start_line", "is_exported", "rank"), "pool")
    refs = staged(refs, "many")
    keys = ["name", "depth", "folder", "language", "kind", "is_exported"]
    first = _by_folder(pool, "file_path").groupBy(*keys).agg(F.min("rank").alias("rank"))
    first = staged(first, "first")
    asked = _by_folder(refs, "ref_path").select("ref_id", "reference_name", "reference_kind", "ref_language", "own", F.col("depth").alias("d"), F.col("folder").alias("f"))
    here = (F.col("reference_name") == F.col("name")) & (F.col("d") == F.col("depth")) & (F.col("f") == F.col("folder"))
    met = asked.where("own").join(first, here & (F.col("ref_language") == F.col("language")))
    met = met.unionByName(asked.where("not own").join(first, here)).where(_admitted(F.col("reference_kind"), F.col("ref_language"), F.col("language")))
    # Greatest score, then least rank, in one number: scores lie below 1000, ranks below 2 ** 50.
    score = _fit() + F.least(F.col("depth") * 15, F.lit(80))
    code = F.shiftleft((1000 - score).cast("long"), 50) + F.col("rank")
    far = met.groupBy("ref_id").agg(F.min(code).alias("code")).select("ref_id", F.col("code").bitwiseAND((1 << 50) - 1).alias("r"))
    far = refs.join(far, "ref_id").join(pool, F.col("r") == F.col("rank")).drop("r")
    beside = refs.join(pool, (F.col("reference_name") == F.col("name")) & (F.col("ref_path") == F.col("file_path")))
    beside = beside.where(_admitted(F.col("reference_kind"), F.col("ref_language"), F.col("language"))).where(~F.col("own") | (F.col("language") == F.col("ref_language")))
    return _best(far.unionByName(beside).withColumn("score", match_score()))


def by_exact_name(refs: DataFrame, nodes: DataFrame, ceiling: int | None = None) -> DataFrame:
    """(ref_id, target, confidence, resolved_by) of references whose whole name is a symbol's.

    One candidate: .9, across languages .5.  Several: the best scored one, of the
    reference's own language if there is any, .7 near by and .4 far off.  How many
    symbols each name has in each language is counted first: references of more
    than DIRECT candidates meet only the best of each folder, and with a
    ``ceiling`` those above it stay open.
    """
    pool = nodes.where("kind <> 'import'")
    asked = refs.select("ref_id", "reference_name", "reference_kind", "ref_language")
    named = _asked_for(pool, ("name",), asked, ("reference_name",))
    counts = named.groupBy(F.col("name").alias("c_name"), F.col("language").alias("c_language")).agg(F.count(F.lit(1)).alias("c"))
    per_name = asked.groupBy("reference_name", "reference_kind", "ref_language").agg(F.count(F.lit(1)).alias("__n"))
    gate = _admitted(F.col("reference_kind"), F.col("ref_language"), F.col("c_language"))
    sizes = (
        per_name.join(counts, F.col("reference_name") == F.col("c_name"))
        .where(gate)
        .groupBy("reference_name", "reference_kind", "ref_language")
        .agg(F.sum("c").alias("total"), F.max(F.col("c_language") == F.col("ref_language")).alias("own"))
    )
    sizes = staged(sizes if ceiling is None else sizes.where(F.col("total") <= ceiling), "sizes")
    few, many = sizes.where(F.col("total") <= DIRECT), sizes.where(F.col("total") > DIRECT)

    def kept(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        its = _asked_for(refs, ("reference_name",), some, ("reference_name",)).join(some, ["reference_name", "reference_kind", "ref_language"])
        return its, _asked_for(pool, ("name",), some, ("reference_name",))

    own, symbols = kept(few)
    candidates = own.join(symbols, F.col("reference_name") == F.col("name")).where(_admitted(F.col("reference_kind"), F.col("ref_language"), F.col("language")))
    best = _best(candidates.where(~F.col("own") | (F.col("language") == F.col("ref_language"))).withColumn("score", match_score()))
    if not many.isEmpty():
        best = best.unionByName(_best_of_many(*kept(many)))
    crossing = F.col("language") != F.col("ref_language")
    near = shared_directories(F.col("ref_path"), F.col("file_path")) >= 30
    confidence = F.when(F.col("total") == 1, F.when(crossing, 0.5).otherwise(0.9)).when(near, 0.7).otherwise(0.4)
    return best.select("ref_id", F.col("id").alias("target"), confidence.alias("confidence"), F.lit("exact-match").alias("resolved_by"))


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names with qualifiers: the one symbol so named or one in the same file .95, else one whose qualified name ends so .85."""
    asked = refs.where(F.col("reference_name").contains("::") | F.col("reference_name").contains("."))
    pool = nodes.where("qualified_name is not null")
    full = asked.join(_asked_for(pool, ("qualified_name",), asked, ("reference_name",)), F.col("reference_name") == F.col("qualified_name"))
    same = F.coalesce(F.col("file_path") == F.col("ref_path"), F.lit(False)).cast("int")
    first = [F.col("file_path").isNull(), F.col("file_path"), F.col("start_line").isNull(), F.col("start_line"), F.col("id")]
    whole = full.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"), F.max(same).alias("own"), F.min_by("id", F.struct(-same, *first)).alias("target"))
    sure = whole.where("n = 1 or own = 1").select("ref_id", "target", F.lit(0.95).alias("confidence"))
    rest = asked.join(sure.select("ref_id"), "ref_id", "left_anti").select("ref_id", "reference_name", "tail", "ref_path")
    symbols = pool.select("id", "name", "qualified_name", "file_path", "start_line")
    ends = F.col("qualified_name").endswith(F.col("reference_name"))
    beside = _asked_for(symbols, ("name", "file_path"), asked, ("tail", "ref_path"))
    own = rest.join(beside, (F.col("tail") == F.col("name")) & (F.col("ref_path") == F.col("file_path"))).where(ends).groupBy("ref_id").agg(F.min_by("id", F.struct(*first)).alias("own"))
    # Elsewhere the answer is one for each name.  A method that very many types have meets only names that end in the same characters before it.
    width = F.least(F.length("reference_name") - F.length("tail"), F.lit(SUFFIX))
    names = asked.select("reference_name", "tail", width.alias("width")).distinct()
    widths = sorted(r[0] for r in names.select("width").distinct().collect())  # at most SUFFIX
    names = names.withColumn("end", F.expr("right(reference_name, length(tail) + width)"))
    keyed = symbols.withColumn("width", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).where("length(qualified_name) >= length(name) + width")
    keyed = keyed.withColumn("met", F.expr("right(qualified_name, length(name) + width)")).drop("width")
    met = names.join(_asked_for(keyed, ("name", "met"), names, ("tail", "end")), (F.col("tail") == F.col("name")) & (F.col("end") == F.col("met")))
    anywhere = met.where(ends).groupBy("reference_name").agg(F.min_by("id", F.struct(*first)).alias("any"))
    near = rest.join(own, "ref_id", "left").join(anywhere, "reference_name").select("ref_id", F.coalesce("own", "any").alias("target"), F.lit(0.85).alias("confidence"))
    return sure.unionByName(near).withColumn("resolved_by", F.lit("qualified-name"))


def by_file_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path-like names that name a file: the whole path .95, its end .85, the only file of that name .7."""
    asked = refs.where(F.col("reference_name").rlike(r"\.[A-Za-z]{1,5}$"))
    files = nodes.where("kind = 'file'")
    met = asked.withColumn("__base", base_name(F.col("reference_name"))).join(files.withColumn("__file", base_name(F.col("file_path"))), F.col("__base") == F.col("__file"))
    level = F.when(F.col("file_path") == F.col("reference_name"), 0.95).when(F.col("file_path").endswith(F.concat(F.lit("/"), F.col("reference_name"))), 0.85).otherwise(0.7)
    best = met.withColumn("confidence", level).groupBy("ref_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"),
        F.min_by("id", F.struct(-F.col("confidence"), -shared_directories(F.col("ref_path"), F.col("file_path")), F.col("id"))).alias("target"),
    )
    return best.where("n = 1 or confidence > 0.7").select("ref_id", "target", "confidence", F.lit("file-path").alias("resolved_by"))


def by_member(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """receiver.member: a method of a type of the receiver's name, case aside for its first letter, .85."""
    asked = refs.withColumn("receiver", F.regexp_extract("reference_name", r"(\w+)(?:\.|::|->)\w+$", 1)).where("receiver <> ''")
    owner = F.regexp_extract("qualified_name", r"(\w+)(?:\.|::)\w+$", 1)
    pool = nodes.where("kind in ('method', 'function')").withColumn("owner", owner).where("owner <> ''")
    pool = _asked_for(pool, ("name", F.lower("owner"), "language"), asked, ("tail", F.lower("receiver"), "ref_language"))
    met = asked.join(pool, (F.col("tail") == F.col("name")) & (F.lower("receiver") == F.lower("owner"))).where("language = ref_language")
    best = met.groupBy("ref_id").agg(F.min_by("id", F.struct(-shared_directories(F.col("ref_path"), F.col("file_path")), F.col("id"))).alias("target"))
    return best.select("ref_id", "target", F.lit(0.85).alias("confidence"), F.lit("member").alias("resolved_by"))


def by_fuzzy_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Case aside, the only callable of the name: .5, across languages .3; one of the own language is preferred."""
    pool = nodes.where("kind in ('function', 'method', 'class')").withColumn("low", F.lower("name"))
    pool = _asked_for(pool, ("low",), refs, (F.lower("reference_name"),))
    counts = pool.groupBy(F.col("low").alias("c_low"), F.col("language").alias("c_language")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("only"))
    met = refs.join(counts, F.lower("reference_name") == F.col("c_low")).where(_admitted(F.col("reference_kind"), F.col("ref_language"), F.col("c_language")))
    own = F.col("c_language") == F.col("ref_language")
    each = met.groupBy("ref_id").agg(
        F.sum("c").alias("n"), F.min("only").alias("any_id"), F.coalesce(F.sum(F.when(own, F.col("c"))), F.lit(0)).alias("n_own"), F.min(F.when(own, F.col("only"))).alias("own_id")
    )
    one = each.where("n_own = 1 or (n_own = 0 and n = 1)")
    return one.select("ref_id", F.coalesce("own_id", "any_id").alias("target"), F.when(F.col("n_own") == 1, 0.5).otherwise(0.3).alias("confidence"), F.lit("fuzzy").alias("resolved_by"))


STRATEGIES = {"qualified-name": by_qualified_name, "exact-match": by_exact_name, "file-path": by_file_path, "member": by_member, "fuzzy": by_fuzzy_name}


def resolve(refs: DataFrame, nodes: DataFrame, extra: tuple = ()) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): the most confident answer to each reference.

    Each strategy (and each function in ``extra``, called alike) gives candidates;
    ties go by the strategy's name and the target's id.  All of them read the same
    two tables, which should be staged.
    """
    # Each is run by itself: the driver plans all of it anew after every stage.
    found = reduce(DataFrame.unionByName, [staged(f(refs, nodes), "answers") for f in (*STRATEGIES.values(), *extra)])
    order = F.struct((-F.col("confidence")).alias("c"), "resolved_by", "target")
    return found.groupBy("ref_id").agg(F.min_by(F.struct("target", "confidence", "resolved_by"), order).alias("r")).select("ref_id", "r.*")


def edges_from(refs: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges for resolved references; the kind follows the two ends.

    extends to an interface from a class is implements, a call of a type is instantiates, a function value references.
    """
    kinds = nodes.select(F.col("id").alias("k_id"), F.col("kind").alias("target_kind"))
    own = nodes.select(F.col("id").alias("o_id"), F.col("kind").alias("source_kind"))
    joined = refs.join(resolved, "ref_id").join(kinds, F.col("target") == F.col("k_id")).join(own, F.col("from_node_id") == F.col("o_id"))
    kind = (
        F.when((F.col("reference_kind") == "extends") & (F.col("target_kind") == "interface") & (F.col("source_kind") != "interface"), "implements")
        .when((F.col("reference_kind") == "calls") & F.col("target_kind").isin("class", "struct"), "instantiates")
        .when(F.col("reference_kind") == "function_ref", "references")
        .otherwise(F.col("reference_kind"))
    )
    metadata = F.to_json(F.struct("confidence", F.col("resolved_by").alias("resolvedBy"), F.col("reference_name").alias("refName"), F.col("reference_kind").alias("refKind")))
    return joined.select(
        F.col("ref_id").alias("id"), F.col("from_node_id").alias("source"), "target", kind.alias("kind"), metadata.alias("metadata"), F.col("ref_line").alias("line"), F.col("ref_col").alias("col"),
        F.lit("heuristic").alias("provenance"),
    )


def inherited_members(refs: DataFrame, resolved: DataFrame, nodes: DataFrame, edges: DataFrame, rounds: int = 4) -> DataFrame:
    """A further round for this.member and self.member references: a member of the enclosing type or of its supertypes.

    Types are climbed at most ``rounds`` steps, nearest first, confidence .85.
    """
    open_ = refs.join(resolved.select("ref_id"), "ref_id", "left_anti").where(F.col("reference_name").rlike(r"^(?:this|self)(?:\.|->|::)\w+$"))
    held = edges.where("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("member"))
    up = edges.where("kind in ('extends', 'implements')").select(F.col("source").alias("sub"), F.col("target").alias("super")).distinct()
    level = open_.join(held, F.col("from_node_id") == F.col("member")).select("ref_id", "tail", F.col("owner").alias("type"))
    names = nodes.select(F.col("id").alias("m_id"), F.col("name").alias("m_name"))
    found = []
    for depth in range(rounds + 1):
        own = level.join(held, F.col("type") == F.col("owner")).join(names, (F.col("member") == F.col("m_id")) & (F.col("tail") == F.col("m_name")))
        found.append(own.groupBy("ref_id").agg(F.min("m_id").alias("target")).withColumn("depth", F.lit(depth)))
        level = level.join(up, F.col("type") == F.col("sub")).select("ref_id", "tail", F.col("super").alias("type")).distinct()
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("ref_id").agg(F.min_by("target", F.struct("depth", "target")).alias("target"))
    return best.select("ref_id", "target", F.lit(0.85).alias("confidence"), F.lit("inherited-member").alias("resolved_by"))
