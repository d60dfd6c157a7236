"""Commit mining: features, TF-IDF, similarity pairs, communities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.text import tokens
from graphloom.runtime import staged

#: Weights of a pair's similarity.
SYMBOL, PLACE, MESSAGE, TICKET, TIME = 0.40, 0.15, 0.25, 0.10, 0.10
TIME_SCALE_MS = 3 * 86_400_000


def ticket_refs(message: Column) -> Column:
    """PROJ-123 and #456, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(message, F.lit(r"[A-Z]+-\d+"), F.lit(0)), F.regexp_extract_all(message, F.lit(r"#\d+"), F.lit(0))))


def scope_of(message: Column) -> Column:
    """The scope of a conventional headline, lower case, or ''."""
    return F.lower(F.regexp_extract(message, r"^\w+\(([^)]*)\)!?:", 1))


def design_relevant(message: Column) -> Column:
    """Features, fixes, refactorings, speed, and headlines without a convention; no reverts."""
    conventional, kept = message.rlike(r"^\w+(\([^)]*\))?!?:"), message.rlike(r"^(feat|fix|refactor|perf)(\([^)]*\))?!?:")
    return (kept | ~conventional) & ~message.rlike(r"^(Revert|Reapply)\b")


def two_segments(paths: Column) -> Column:
    """The first two segments of each path."""
    return F.array_distinct(F.transform(paths, lambda p: F.array_join(F.slice(F.split(p, "/"), 1, 2), "/")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets have 0."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(0.0)


def tf_idf(docs: DataFrame, id_column: str, text: str, least: int = 3) -> DataFrame:
    """(id, term, weight): term share times ln((N + 1) / (df + 1)) + 1, for words of ``least`` letters or more."""
    words = docs.select(F.col(id_column).alias("id"), F.filter(tokens(F.col(text)), lambda t: F.length(t) >= least).alias("words"))
    counts = words.select("id", F.size("words").alias("n"), F.explode("words").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    total = words.agg(F.count(F.lit(1)).alias("docs"))
    df = counts.groupBy(F.col("term").alias("d_term")).agg(F.count(F.lit(1)).alias("df"))
    joined = counts.join(df, F.col("term") == F.col("d_term")).crossJoin(F.broadcast(total))
    return joined.select("id", "term", (F.col("c") / F.col("n") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))


def cosine_of_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) for given pairs of ids; a missing or zero vector has 0."""
    norm = vectors.groupBy(F.col("id").alias("n_id")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    left = pairs.join(vectors.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa")), "a")
    dot = left.join(vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(dot, ["a", "b"], "left").join(norm.select(F.col("n_id").alias("a"), F.col("norm").alias("na")), "a", "left").join(norm.select(F.col("n_id").alias("b"), F.col("norm").alias("nb")), "b", "left")
    scale = F.col("na") * F.col("nb")
    return out.select("a", "b", F.coalesce(F.when(scale > 0, F.col("dot") / scale), F.lit(0.0)).alias("cosine"))


def telling_terms(vectors: DataFrame) -> DataFrame:
    """(id, term, rest): per term of a vector the share of its norm that it holds together with all commoner terms.

    The rarest common term of two vectors with a cosine of c stands where the rest of
    either vector, commoner terms only, still has c of the norm: terms with a rest of c
    or more are enough to meet by.
    """
    df = vectors.groupBy(F.col("term").alias("d_term")).agg(F.count(F.lit(1)).alias("df"))
    common_first = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("term"))
    rest = F.sum(F.col("weight") * F.col("weight"))
    sums = vectors.join(df, F.col("term") == F.col("d_term")).select(
        "id", "term", rest.over(common_first.rowsBetween(Window.unboundedPreceding, 0)).alias("rest"), rest.over(Window.partitionBy("id")).alias("whole")
    )
    return sums.select("id", "term", F.sqrt(F.col("rest") / F.col("whole")).alias("rest"))


#: Spans of time within which commits meet by words, with the greatest part of TIME that pairs beyond the span before can still have.
SPANS_MS = ((TIME_SCALE_MS, 1.0), (10 * TIME_SCALE_MS, math.exp(-1)), (None, math.exp(-10)))


def _cohesion_penalty(cohesion: Column) -> Column:
    return 0.6 + 0.4 * F.least(cohesion / 2.0, F.lit(1.0))


def commit_pairs(commits: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(a, b, score), a < b: pairs of commits as similar as ``threshold`` or more.

    ``commits`` has id, message, ts_ms, symbols, files, tickets.  Candidates come
    from equality joins and no pair is lost: place, message and time give .5
    together, so above that a pair shares a symbol or a ticket.  Below, a pair that
    shares none of symbols, tickets, files and folders has only message and time.
    How alike its messages must be follows from either commit's own penalty and
    from the time between them: so far apart, so alike, so few of the rarest words
    to meet by.
    """
    if threshold < 0.25:
        raise ValueError("candidates are laid out for thresholds of 0.25 or more")
    vectors = tf_idf(commits, "id", "message")
    kinds = {"s:": F.col("symbols"), "t:": F.col("tickets")}
    if threshold < PLACE + MESSAGE + TIME:
        kinds |= {"f:": F.col("files"), "d:": two_segments(F.col("files"))}
        vectors = staged(vectors, "vectors")
    named = [F.transform(c, lambda s, k=k: F.concat(F.lit(k), s)) for k, c in kinds.items()]
    keys = commits.select("id", F.explode(F.array_distinct(F.concat(*named))).alias("key"))
    cohesion = F.size("symbols") / F.greatest(F.size("files"), F.lit(1))
    if threshold < PLACE + MESSAGE + TIME:
        own = commits.select(F.col("id").alias("o_id"), "ts_ms", _cohesion_penalty(cohesion).alias("penalty"))
        terms = staged(telling_terms(vectors).join(own, F.col("id") == F.col("o_id")).drop("o_id"), "terms")
        for span, time in SPANS_MS:
            met = terms.where(F.col("rest") >= (threshold / F.col("penalty") - TIME * time) / MESSAGE - 1e-9)
            # Two neighbouring bins each: commits within a span share one.
            at = F.floor(F.col("ts_ms") / span) if span else F.lit(0)
            bins = F.explode(F.array(at, at + 1)) if span else F.lit(0)
            keys = keys.unionByName(met.select("id", "term", bins.alias("bin")).select("id", F.concat_ws(":", F.lit(f"w{span or ''}"), F.col("bin").cast("string"), "term").alias("key")))
    keys = staged(keys.distinct(), "keys")
    pairs = keys.select(F.col("id").alias("a"), "key").join(keys.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    pairs = staged(pairs, "pairs")
    cosine = cosine_of_pairs(vectors, pairs)
    facts = commits.select("id", "ts_ms", "symbols", "files", two_segments(F.col("files")).alias("dirs"), "tickets", cohesion.alias("cohesion"))
    a, b = (facts.select(*[F.col(c).alias(f"{p}_{c}") for c in facts.columns]) for p in "ab")
    met = cosine.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
    raw = (
        SYMBOL * jaccard(F.col("a_symbols"), F.col("b_symbols"))
        + PLACE * F.greatest(jaccard(F.col("a_files"), F.col("b_files")), jaccard(F.col("a_dirs"), F.col("b_dirs")))
        + MESSAGE * F.col("cosine")
        + TICKET * jaccard(F.col("a_tickets"), F.col("b_tickets"))
        + TIME * F.exp(-F.abs(F.col("a_ts_ms") - F.col("b_ts_ms")) / TIME_SCALE_MS)
    )
    penalty = _cohesion_penalty(F.least("a_cohesion", "b_cohesion"))
    return met.select("a", "b", (raw * penalty).alias("score")).where(F.col("score") >= threshold)


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): connected components of (a, b), named by their least id; large and small star steps until nothing moves."""
    links = staged(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = staged(links.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")), "label")
    while True:
        near = links.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("least"))
        hop = label.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", "least").alias("component"))
        # Follow the label's own label too, so long chains shorten by half each round.
        jump = hop.select(F.col("id").alias("j_id"), F.col("component").alias("j"))
        after = staged(hop.join(jump, F.col("component") == F.col("j_id"), "left").select("id", F.least("component", F.coalesce("j", "component")).alias("component")), "label")
        if after.join(label.withColumnRenamed("component", "was"), "id").where("component <> was").isEmpty():
            return after
        label = after


def _leiden(pdf: pd.DataFrame, resolution: float) -> pd.DataFrame:
    """Communities of one component: local moves in id order, refinement inside the communities, aggregation of the refined parts."""
    weights: dict = {}
    for a, b, w in zip(pdf["a"], pdf["b"], pdf["score"]):
        weights.setdefault(a, {})[b] = weights.setdefault(a, {}).get(b, 0.0) + w
        weights.setdefault(b, {})[a] = weights.setdefault(b, {}).get(a, 0.0) + w
    members = {v: [v] for v in sorted(weights)}
    graph, loops = weights, dict.fromkeys(weights, 0.0)
    home = {v: v for v in graph}
    while True:
        degree = {v: sum(graph[v].values()) + loops[v] for v in graph}
        m2 = sum(degree.values()) or 1.0

        def best_of(v, where, total, among=None, degree=degree, m2=m2, graph=graph):
            """(gain over staying, community) of the best move of v."""
            gain: dict = {where[v]: 0.0}
            for u, w in graph[v].items():
                if among is None or among[u] == among[v]:
                    gain[where[u]] = gain.get(where[u], 0.0) + w
            worth = {c: g - resolution * degree[v] * (total[c] - (degree[v] if c == where[v] else 0.0)) / m2 for c, g in gain.items()}
            best = max(sorted(worth), key=worth.get)
            return worth[best] - worth[where[v]], best

        total: dict = {}
        for v, c in home.items():
            total[c] = total.get(c, 0.0) + degree[v]
        moved = True
        while moved:  # each move raises modularity, so this ends
            moved = False
            for v in sorted(graph):
                more, c = best_of(v, home, total)
                if more > 1e-12:
                    total[home[v]] -= degree[v]
                    total[c] += degree[v]
                    home[v], moved = c, True
        # Refinement: from single nodes on, each once, into a part of its own community.
        part, size, mass = {v: v for v in graph}, dict.fromkeys(graph, 1), dict(degree)
        for v in sorted(graph):
            if size[part[v]] == 1:
                more, c = best_of(v, part, mass, home)
                if more > 1e-12:
                    mass[c] += degree[v]
                    mass[part[v]] -= degree[v]
                    size[part[v]] -= 1
                    size[c] += 1
                    part[v] = c
        if len(set(part.values())) == len(graph):
            break
        merged: dict = {}
        inner: dict = {}
        held: dict = {}
        for v, c in part.items():
            held.setdefault(c, []).extend(members[v])
            inner[c] = inner.get(c, 0.0) + loops[v]
            merged.setdefault(c, {})
            for u, w in graph[v].items():
                if part[u] == c:
                    inner[c] += w
                else:
                    merged[c][part[u]] = merged[c].get(part[u], 0.0) + w
        home = {c: home[c] for c in merged}
        graph, loops, members = merged, inner, held
    found: dict = {}
    for v, xs in members.items():
        found.setdefault(home[v], []).extend(xs)
    return pd.DataFrame([(x, min(xs)) for xs in found.values() for x in xs], columns=["id", "community"])


def _grouped(links: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """(id, home): the same steps as rounds of joins, for components that no task should hold.

    ``links`` (a, b, w) both ways, ``nodes`` (id, k) with strengths.  In a round every
    node sees the best community next to it and half of them, by hash, may move;
    rounds end when two in a row move nothing or modularity has not risen for four.
    Communities are then split where they do not hang together, and the parts are
    the nodes of the next level.
    """
    m2 = nodes.agg(F.sum("k")).first()[0] or 1.0
    place = staged(nodes.select("id", F.col("id").alias("node")), "place")  # original node -> node of the level
    home = staged(nodes.select("id", F.col("id").alias("home")), "home")
    while True:
        best, since, quiet, turn = None, 0, 0, 0
        while quiet < 2 and since < 4:
            turn += 1
            rich = home.join(nodes, "id")
            total = rich.groupBy(F.col("home").alias("t_home")).agg(F.sum("k").alias("total"))
            near = links.join(home.select(F.col("id").alias("b"), F.col("home").alias("c")), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
            stay = rich.select(F.col("id").alias("a"), F.col("home").alias("c"), F.lit(0.0).alias("w"))
            options = near.unionByName(stay).groupBy("a", "c").agg(F.sum("w").alias("w")).join(rich.select(F.col("id").alias("a"), "home", "k"), "a").join(total, F.col("c") == F.col("t_home"))
            worth = F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("home"), F.col("k")).otherwise(0.0)) / m2
            seen = options.select("a", "c", "home", worth.alias("worth"), F.when(F.col("c") == F.col("home"), F.col("w")).alias("inner"))
            picked = seen.groupBy("a", "home").agg(F.max(F.struct("worth", "c")).alias("top"), F.max(F.when(F.col("c") == F.col("home"), F.col("worth"))).alias("stays"), F.max("inner").alias("inner"))
            may = (F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0) & (F.col("top.worth") > F.col("stays") + 1e-12)
            step = staged(picked.select(F.col("a").alias("id"), F.when(may, F.col("top.c")).otherwise(F.col("home")).alias("home"), F.col("home").alias("was"), "inner"), "home")
            inner, moved = step.agg(F.sum("inner"), F.count_if(F.col("home") != F.col("was"))).first()
            quality = (inner or 0.0) / m2 - resolution * sum(r[0] for r in total.agg(F.sum(F.pow(F.col("total") / m2, 2))).collect())
            if best is None or quality > best[0] + 1e-9:
                best, since = (quality, home), 0
            else:
                since += 1
            quiet = quiet + 1 if not moved else 0
            home = step.select("id", "home")
        home = best[1] if since >= 4 else home
        a, b = (home.select(F.col("id").alias(x), F.col("home").alias(f"h_{x}")) for x in "ab")
        within = links.join(a, "a").join(b, "b").where("h_a = h_b").select("a", "b")
        joined = components(within).select(F.col("id").alias("c_id"), "component")
        part = staged(nodes.join(joined, F.col("id") == F.col("c_id"), "left").select("id", "k", F.coalesce("component", "id").alias("part")), "part")
        place = staged(place.join(part.select(F.col("id").alias("node"), "part"), "node").select("id", F.col("part").alias("node")), "place")
        before, after = nodes.count(), part.select("part").distinct().count()
        if before == after:
            return place.join(home.select(F.col("id").alias("node"), "home"), "node").select("id", "home")
        pa, pb = (part.select(F.col("id").alias(x), F.col("part").alias(f"p_{x}")) for x in "ab")
        links = staged(links.join(pa, "a").join(pb, "b").where("p_a <> p_b").groupBy(F.col("p_a").alias("a"), F.col("p_b").alias("b")).agg(F.sum("w").alias("w")), "links")
        home = staged(part.join(home, "id").groupBy(F.col("part").alias("id")).agg(F.min("home").alias("home")), "home")
        nodes = staged(part.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k")), "nodes")


#: Links of one component that a task holds; larger components are worked on by rounds of joins.
LINKS_IN_TASK = 200_000


def communities(pairs: DataFrame, resolution: float = 1.0, in_task: int = LINKS_IN_TASK) -> DataFrame:
    """(id, community): Leiden communities of weighted pairs (a, b, score), named by their least id.

    Every component is worked on by itself and in a fixed order, so results do not
    vary and no link is left out: components of up to ``in_task`` links whole in one
    task, larger ones together by rounds of joins with the same objective.
    """
    kind = dict(pairs.dtypes)["a"]
    pairs = staged(pairs, "pairs")
    labelled = staged(pairs.join(components(pairs), F.col("a") == F.col("id")).select("a", "b", "score", "component"), "labelled")
    large = labelled.groupBy(F.col("component").alias("l_component")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_task).select("l_component")
    if large.isEmpty():
        return labelled.groupBy("component").applyInPandas(lambda pdf: _leiden(pdf, resolution), f"id {kind}, community {kind}")
    small = labelled.join(large, F.col("component") == F.col("l_component"), "left_anti")
    out = small.groupBy("component").applyInPandas(lambda pdf: _leiden(pdf, resolution), f"id {kind}, community {kind}")
    rest = labelled.join(large, F.col("component") == F.col("l_component"), "left_semi")
    both = rest.select("a", "b", F.col("score").alias("w")).unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("score").alias("w")))
    links = staged(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    homes = staged(_grouped(links, staged(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "nodes"), resolution), "homes")
    names = homes.groupBy(F.col("home").alias("n_home")).agg(F.min("id").alias("community"))
    return out.unionByName(homes.join(names, F.col("home") == F.col("n_home")).select("id", "community"))


def modularity(pairs: list[tuple], community: dict, resolution: float = 1.0) -> float:
    """Of a small graph on the driver, for tests."""
    degree: dict = {}
    inside: dict = {}
    m = 0.0
    for a, b, w in pairs:
        m += w
        degree[community[a]] = degree.get(community[a], 0.0) + w
        degree[community[b]] = degree.get(community[b], 0.0) + w
        if community[a] == community[b]:
            inside[community[a]] = inside.get(community[a], 0.0) + w
    return sum(inside.get(c, 0.0) / m - resolution * math.pow(d / (2 * m), 2) for c, d in degree.items())
