"""Graph operators: one frontier loop, and what is built on it.

Loops run level by level over DataFrames.  Each level is written to the shared
folder, so plans stay short and a lost executor costs a re-read.  Only counts
reach the driver, and links that were counted first (``compact``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import directory, is_test_file
from graphloom.operators.compact import compact, search_compact
from graphloom.operators.store import drop_orphans
from graphloom.runtime import shuffle_partitions, staged

#: Edge kinds by which one symbol uses another.
USES = ("calls", "references", "imports", "instantiates")
#: Kinds whose members change with them.
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
SUPERTYPE = ("extends", "implements")
#: Levels after which a deep search writes what it has seen as one table, so its plan stays short.
COMPACT_EVERY = 8


def of_kinds(edges: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    return edges if kinds is None else edges.where(F.col("kind").isin(*kinds))


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst) in the direction of travel: out, in or both."""
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def reach(links: DataFrame, roots: DataFrame, max_depth: int | None, keep: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(root, id, depth): everything each root reaches over ``links`` (src, dst), with its least depth.

    ``roots`` has root and id; ``keep`` (id) restricts what may be entered,
    ``stop`` (id) is entered but not left.  Cycles are harmless.
    """
    links = staged(links.distinct(), "links")
    seen = staged(roots.select("root", "id").distinct().withColumn("depth", F.lit(0)), "level")
    level, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        leave = level if stop is None else level.join(stop.select("id"), "id", "left_anti")
        step = leave.join(links, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        if keep is not None:
            step = step.join(keep.select("id"), "id", "left_semi")
        level = staged(step.join(seen, ["root", "id"], "left_anti").select("root", "id", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if depth % COMPACT_EVERY == 0:
            seen = staged(seen, "seen")
    return seen


def roots_of(ids: DataFrame) -> DataFrame:
    """Each id as the root of its own search."""
    return ids.select(F.col("id").alias("root"), F.col("id"))


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    keys = ids.select(F.col("id").alias("__id")).distinct()
    for end in ("source", "target"):
        edges = edges.join(keys, F.col(end) == F.col("__id"), "left_semi")
    return edges


def capped_incoming(edges: DataFrame, cap: int = 250) -> DataFrame:
    """At most ``cap`` incoming edges per target, the oldest first (the cap is the feature: hubs stay readable).

    Ranked in two steps, so a hub's edges are cut down in many tasks first.
    """
    part = Window.partitionBy("target", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("target").orderBy("id")
    some = edges.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= cap)
    return some.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= cap).drop("__r")


def callers(edges: DataFrame, ids: DataFrame, depth: int = 1, cap: int = 250) -> DataFrame:
    """(root, id, depth) of the symbols that use each root, at most ``cap`` users per symbol; roots excluded."""
    used = capped_incoming(of_kinds(edges, USES), cap)
    return reach(adjacency(used, "in"), roots_of(ids), depth).where("depth > 0")


def callees(edges: DataFrame, ids: DataFrame, depth: int = 1) -> DataFrame:
    return reach(adjacency(of_kinds(edges, USES)), roots_of(ids), depth).where("depth > 0")


def call_graph(edges: DataFrame, ids: DataFrame, depth: int = 2) -> DataFrame:
    """(root, id, role): the root, its callers and its callees."""
    focal = roots_of(ids).withColumn("role", F.lit("focal"))
    up = callers(edges, ids, depth).select("root", "id", F.lit("caller").alias("role"))
    down = callees(edges, ids, depth).select("root", "id", F.lit("callee").alias("role"))
    return focal.unionByName(up).unionByName(down)


def type_hierarchy(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(root, id, relation, depth): all supertypes and subtypes."""
    kin = of_kinds(edges, SUPERTYPE)
    up = reach(adjacency(kin), roots_of(ids), None).where("depth > 0").withColumn("relation", F.lit("ancestor"))
    down = reach(adjacency(kin, "in"), roots_of(ids), None).where("depth > 0").withColumn("relation", F.lit("descendant"))
    return up.unionByName(down)


def impact(edges: DataFrame, nodes: DataFrame, ids: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, depth): what a change of each root may touch.

    A container passes the change to its members at no cost; any other incoming
    edge costs one step.  Nodes at the last depth are not expanded.
    """
    members = staged(
        edges.where("kind = 'contains'")
        .join(nodes.where(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("c_id")), F.col("source") == F.col("c_id"))
        .select(F.col("source").alias("src"), F.col("target").alias("dst"))
        .distinct(),
        "members",
    )
    users = staged(adjacency(edges.where("kind <> 'contains'"), "in").distinct(), "users")

    def within(level: DataFrame, seen: DataFrame) -> DataFrame:
        """The level and everything its containers hold, however deep."""
        whole, fresh = level, level
        while True:
            held = fresh.join(members, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
            fresh = staged(held.join(seen.unionByName(whole.select("root", "id")), ["root", "id"], "left_anti"), "held")
            if fresh.isEmpty():
                return whole
            whole = whole.unionByName(fresh)

    start = staged(roots_of(ids).distinct(), "level")
    level = within(start, start.limit(0)) if depth > 0 else start
    seen = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = level.join(users, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        fresh = staged(step.join(seen, ["root", "id"], "left_anti"), "level")
        if fresh.isEmpty():
            break
        level = within(fresh, seen.select("root", "id")) if d < depth else fresh
        seen = seen.unionByName(level.withColumn("depth", F.lit(d)))
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame | None = None, kinds: tuple[str, ...] | None = None, max_depth: int | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None, paths: bool = True, known: DataFrame | None = None) -> DataFrame:
    """(source, target, path, hops) of one shortest path per connected (source, target): of ``pairs``, or from each of ``sources`` (id) to each of ``targets`` (id).

    Of equally short paths the least array of ids is given; without ``paths`` only
    the hops are.  With ``known`` (id) ``edges`` is a stored table and only its links
    between these ids count.  The search ends by itself where nothing new is reached,
    unless ``max_depth`` ends it earlier.  A graph that fits the memory of a task is
    searched there, else level by level in joins; both give the same rows.
    """
    edges = of_kinds(edges, kinds).select("source", "target").where("source is not null and target is not null")
    links = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    links = staged(links, "links") if known is None else links
    if pairs is None:
        starts, ends = sources.select(F.col("id").alias("root")), targets.select(F.col("id").alias("p_target"))
        hit = F.col("id") == F.col("p_target")
    else:
        pairs = staged(pairs.select(F.col("source").alias("p_source"), F.col("target").alias("p_target")), "pairs")
        starts, ends, hit = pairs.select(F.col("p_source").alias("root")), pairs, (F.col("root") == F.col("p_source")) & (F.col("id") == F.col("p_target"))
    starts = staged(starts.where("root is not null").distinct(), "starts")
    if (graph := compact(links, starts, known)) is not None:
        return search_compact(graph, starts, ends, max_depth, paths)
    if known is not None:
        links = drop_orphans(edges, known).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    links, ends = staged(links.distinct(), "links"), staged(ends.distinct(), "ends")
    level = staged(starts.select("root", F.col("root").alias("id"), *([F.array("root").alias("path")] if paths else [])), "level")
    seen, found, depth = level.select("root", "id"), [], 0
    while True:
        hops = F.lit(depth).alias("hops")
        found.append(level.join(ends, hit, "left_semi").select(F.col("root").alias("source"), F.col("id").alias("target"), *(["path"] if paths else []), hops))
        if depth == max_depth:
            break
        depth += 1
        step = level.join(links, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"), *([F.concat("path", F.array("dst")).alias("path")] if paths else []))
        step = step.groupBy("root", "id").agg(F.min("path").alias("path")) if paths else step.distinct()
        level = staged(step.join(seen, ["root", "id"], "left_anti"), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("root", "id"))
        if depth % COMPACT_EVERY == 0:
            seen, found = staged(seen, "seen"), [staged(reduce(DataFrame.unionByName, found), "found")]
    return reduce(DataFrame.unionByName, found)


def first_parents(edges: DataFrame) -> DataFrame:
    """(child, parent): the first containing node of each node."""
    return edges.where("kind = 'contains'").groupBy(F.col("target").alias("child")).agg(F.min_by("source", "id").alias("parent"))


def ancestors(edges: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """(root, id, depth): the chain of containing nodes, nearest first; cycles end it."""
    return reach(first_parents(edges).select(F.col("child").alias("src"), F.col("parent").alias("dst")), roots_of(ids), most).where("depth > 0")


def children(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class")) -> DataFrame:
    """Unexported nodes of the kinds that nothing but their container points at."""
    used = edges.where("kind <> 'contains'").select(F.col("target").alias("__id")).distinct()
    hidden = nodes.where(F.col("kind").isin(*kinds) & ~F.coalesce("is_exported", F.lit(False)))
    return hidden.join(used, F.col("id") == F.col("__id"), "left_anti")


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: in and out degree, calls each way, children and depth of containment."""
    edges = staged(edges.select("id", "source", "target", "kind"), "edges")
    ends = edges.select(F.col("target").alias("__id"), F.lit("in").alias("way"), "kind").unionByName(edges.select(F.col("source").alias("__id"), F.lit("out").alias("way"), "kind"))
    counts = ends.groupBy("__id").agg(
        F.count_if(F.col("way") == "in").alias("incoming"),
        F.count_if(F.col("way") == "out").alias("outgoing"),
        F.count_if((F.col("way") == "out") & (F.col("kind") == "calls")).alias("calls"),
        F.count_if((F.col("way") == "in") & (F.col("kind") == "calls")).alias("callers"),
        F.count_if((F.col("way") == "out") & (F.col("kind") == "contains")).alias("children"),
    )
    depth = ancestors(edges, nodes.select("id")).groupBy(F.col("root").alias("__root")).agg(F.max("depth").alias("depth"))
    out = nodes.select("id").join(counts, F.col("id") == F.col("__id"), "left").join(depth, F.col("id") == F.col("__root"), "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("incoming", "outgoing", "calls", "callers", "children", "depth")])


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, depends_on): a symbol of one file points at a symbol of another, other than by containment."""
    at = nodes.select("id", "file_path").where("file_path is not null")
    s = at.select(F.col("id").alias("s_id"), F.col("file_path").alias("s_path"))
    t = at.select(F.col("id").alias("t_id"), F.col("file_path").alias("t_path"))
    # A hot target comes to its join once per file that uses it, not once per edge.
    used = edges.where("kind <> 'contains'").select("source", "target").join(s, F.col("source") == F.col("s_id")).select("s_path", "target").distinct()
    return (
        used.join(t, F.col("target") == F.col("t_id"))
        .where("s_path <> t_path")
        .select(F.col("s_path").alias("file_path"), F.col("t_path").alias("depends_on"))
        .distinct()
    )


def affected_tests(dependencies: DataFrame, changed: DataFrame, depth: int = 5) -> DataFrame:
    """(file_path, depth): test files that depend on the changed files; tests are not passed through."""
    links = staged(dependencies.select(F.col("depends_on").alias("src"), F.col("file_path").alias("dst")), "dependencies")
    files = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    tests = files.where(is_test_file(F.col("id")))
    roots = changed.select(F.lit("changed").alias("root"), F.col("file_path").alias("id"))
    return reach(links, roots, depth, stop=tests).where(is_test_file(F.col("id"))).select(F.col("id").alias("file_path"), "depth")


def cycles(links: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of two nodes or more, named by their least node.

    Repeated until no edge is left: nodes without way in or out are trimmed as
    long as that pays, the rest is coloured by the least node that reaches it, and
    what reaches its colour back is a component.  Each round takes at least one
    component per colour away, so it ends.
    """
    links = staged(links.select("src", "dst").where("src <> dst").distinct(), "links")
    found = []
    count = links.count()
    while count:
        before = None
        while count and (before is None or count < 0.9 * before):  # what has no way in or no way out lies on no cycle
            before = count
            links = links.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            links = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
            links = staged(links, "links")
            count = links.count()
        if not count:
            break
        colour = staged(links.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")), "colour")
        while True:  # least name that reaches each node
            passed = links.join(colour, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.min("colour").alias("least"))
            following = staged(colour.join(passed, F.col("id") == F.col("to"), "left").select("id", F.least("colour", "least").alias("colour")), "colour")
            same = following.join(colour.withColumnRenamed("colour", "was"), "id").where("colour <> was").isEmpty()
            colour = following
            if same:
                break
        a = colour.select(F.col("id").alias("src"), F.col("colour").alias("c_src"))
        b = colour.select(F.col("id").alias("dst"), F.col("colour").alias("c_dst"))
        inside = staged(links.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("colour")), "inside")
        back = reach(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), inside.select(F.col("colour").alias("root"), F.col("colour").alias("id")).distinct(), None)
        component = staged(back.select(F.col("root").alias("component"), "id"), "component")
        sizes = component.groupBy("component").count().where("count > 1")
        found.append(component.join(sizes, "component", "left_semi").select("id", "component"))
        done = component.select(F.col("id").alias("__id"))
        links = inside.join(done, F.col("src") == F.col("__id"), "left_anti").join(done, F.col("dst") == F.col("__id"), "left_anti").select("src", "dst")
        links = staged(links, "links")
        count = links.count()
    empty = links.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
    return reduce(DataFrame.unionByName, found, empty)


def random_walk(edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] | None = None, restart: float = 0.25, rounds: int = 25) -> DataFrame:
    """(id, score): mass of a walk with restart at ``seeds`` (id) over undirected edges.

    Parallel edges count as often as they occur, loops not at all; a node without
    edges keeps its mass.  Each round is one join and one sum by node: partial sums
    in the map tasks keep hubs cheap.
    """
    both = adjacency(of_kinds(edges, kinds).where("source <> target"), "both")
    weights = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    degree = weights.groupBy("src").agg(F.sum("w").alias("deg"))
    parts = shuffle_partitions(edges.sparkSession)
    # The links of a source that has more than its part of all are spread over as many keys as there are tasks; such sources are fewer than four a task.
    links = staged(weights.join(degree, "src").select("src", "dst", (F.col("w") / F.col("deg")).alias("p")), "walk")
    fan = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    whole = links.count()
    heavy = [r[0] for r in fan.where(F.col("n") > max(1000, whole / (4 * parts))).select("src").collect()]
    is_heavy = F.col("src").isin(heavy) if heavy else F.lit(False)
    links = links.withColumn("salt", F.when(is_heavy, F.pmod(F.xxhash64("dst"), F.lit(parts))).otherwise(0).cast("int"))
    # Laid out once: a round then moves the masses only.  Lost blocks are read again from the staged table.
    links = links.repartition(parts, "src", "salt").persist()
    salts = F.when(F.col("id").isin(heavy), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))) if heavy else F.array(F.lit(0))
    start = seeds.select("id").distinct()
    n = start.count()
    begin = staged(start.withColumn("r", F.lit(1.0 / max(1, n))), "seeds")
    # Mass only moves along edges, so none but a seed can be stuck, and a stuck seed keeps its share for ever.
    has_way = links.select(F.col("src").alias("id")).distinct()
    stuck = begin.join(has_way, "id", "left_anti").select("id", F.col("r").alias("m"))
    begin = staged(begin.join(has_way, "id", "left_semi"), "seeds")
    back = begin.select("id", (F.col("r") * restart).alias("m"))
    mass = begin.select("id", F.col("r").alias("m"))
    for k in range(rounds):
        spread = mass.select("id", "m", F.explode(salts).alias("m_salt"))
        moved = spread.hint("shuffle_hash").join(links, (F.col("id") == F.col("src")) & (F.col("m_salt") == F.col("salt"))).select(F.col("dst").alias("id"), (F.col("m") * F.col("p") * (1 - restart)).alias("m"))
        mass = moved.unionByName(back).groupBy("id").agg(F.sum("m").alias("m"))
        if k % 5 == 4 and k + 1 < rounds:
            mass = staged(mass, "mass")
    mass = staged(mass.unionByName(stuck), "mass")
    links.unpersist()
    return mass.select("id", F.col("m").alias("score"))


def chains(edges: DataFrame, roots: DataFrame, hops: int = 6, least: int = 3, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """(path): longest call paths that start and end in ``roots`` (id), without repeats, of ``least`` nodes or more.

    Paths over which another one runs are left out.  A path goes on only to where an
    end is still in reach with the hops that are left.
    """
    links = staged(adjacency(of_kinds(edges, kinds)).where("src <> dst").distinct(), "links")
    ends = staged(roots.select(F.col("id").alias("end_id")).distinct(), "ends")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    away = staged(reach(back, ends.select(F.lit("end").alias("root"), F.col("end_id").alias("id")), hops - 1).select(F.col("id").alias("near"), "depth"), "away")
    level = ends.select(F.array("end_id").alias("path"), F.col("end_id").alias("last"))
    found = []
    for left in reversed(range(hops)):
        reachable = links.join(away.where(F.col("depth") <= left), F.col("dst") == F.col("near"), "left_semi")
        level = staged(level.join(reachable, F.col("last") == F.col("src")).where(~F.expr("array_contains(path, dst)")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")), "paths")
        found.append(level.join(ends, F.col("last") == F.col("end_id"), "left_semi").where(F.size("path") >= least).select("path"))
    whole = staged(reduce(DataFrame.unionByName, found), "paths")
    longer = whole.select(F.explode(F.sequence(F.lit(1), F.size("path"))).alias("lo"), "path").select("path", "lo", F.explode(F.sequence(F.lit(least), F.size("path") - 1)).alias("n"))
    inner = longer.where(F.col("lo") + F.col("n") - 1 <= F.size("path")).select(F.expr("slice(path, lo, n)").alias("path")).distinct()
    return whole.distinct().join(inner, "path", "left_anti")


def module_structure(nodes: DataFrame) -> DataFrame:
    """(directory, n_files, n_symbols)."""
    at = nodes.where("file_path is not null")
    return at.groupBy(directory(F.col("file_path")).alias("directory")).agg(F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_symbols"))


def dominant_file(nodes: DataFrame, edges: DataFrame, least: int = 20) -> DataFrame:
    """(file_path, n_edges, runner_up): the file with most edges inside itself, if it has ``least``, and the next one's count."""
    at = nodes.select("id", "file_path")
    by_file = edges.join(at.select(F.col("id").alias("s_id"), F.col("file_path").alias("s_path")), F.col("source") == F.col("s_id")).groupBy("s_path", "target").agg(F.count(F.lit(1)).alias("n"))
    inner = (
        by_file.join(at.select(F.col("id").alias("t_id"), F.col("file_path").alias("t_path")), F.col("target") == F.col("t_id"))
        .where("s_path = t_path")
        .groupBy(F.col("s_path").alias("file_path"))
        .agg(F.sum("n").alias("n_edges"))
    )
    top = inner.orderBy(F.desc("n_edges"), "file_path").limit(2)
    ranked = top.withColumn("runner_up", F.lead("n_edges").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_edges"), "file_path")))
    return ranked.orderBy(F.desc("n_edges"), "file_path").limit(1).where(F.col("n_edges") >= least)


def filtered_subgraph(nodes: DataFrame, edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that meet the condition and the edges among them."""
    kept = nodes.where(condition)
    return kept, induced_edges(edges, kept)


def qualified_glob(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose qualified name matches a glob from end to end (* any run, ? one character)."""
    regex = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r".^$+()[]{}|\\" else c) for c in pattern)
    return nodes.where(F.col("qualified_name").rlike(f"^{regex}$"))


def file_glob(files: DataFrame, pattern: str, column: str = "path") -> DataFrame:
    """Files whose path holds a match of a glob: * stops at a slash, ** crosses it."""
    regex, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            regex, i = regex + ".*", i + 2
            continue
        c = pattern[i]
        regex += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".^$+()[]{}|\\" else c)
        i += 1
    return files.where(F.col(column).rlike(regex))
