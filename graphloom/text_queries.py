"""Retrieval queries over the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import catalog as C
from graphloom.functions.names import cjk_spaced, kind_bonus, segments
from graphloom.operators import text as X
from graphloom.runtime import staged
from graphloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def symbols(spark, d):
    return C.nodes(spark, d, "id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "docstring", "signature")


_BM25 = (
    C.WITH
    + r""", t AS (SELECT id, regexp_extract_all(lower(coalesce(name, '')), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(coalesce(qualified_name, '')), '[\p{L}\p{N}]+') AS b,
        regexp_extract_all(lower(coalesce(docstring, '')), '[\p{L}\p{N}]+') AS c, regexp_extract_all(lower(coalesce(signature, '')), '[\p{L}\p{N}]+') AS s FROM n),
    w AS (SELECT id, len(a) + len(b) + len(c) + len(s) AS length, q,
        20 * len(list_filter(a, lambda x: starts_with(x, q))) + 5 * len(list_filter(b, lambda x: starts_with(x, q))) + len(list_filter(c, lambda x: starts_with(x, q))) + 2 * len(list_filter(s, lambda x: starts_with(x, q))) AS f
        FROM t, (SELECT unnest(['token', 'cache']) AS q)),
    st AS (SELECT q, count(*) FILTER (WHERE f > 0) AS df, count(*) AS n, avg(length) AS mean FROM w GROUP BY q),
    sc AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM w JOIN st USING (q) GROUP BY id)"""
)


@query(_BM25 + " SELECT id, round(score, 6) AS score FROM sc WHERE score > 0")
def bm25_prefix(spark, d):
    """BM25 by prefix over all symbols."""
    return X.bm25(symbols(spark, d), ["token", "cache"]).select("id", F.round("score", 6).alias("score"))


@query(
    C.WITH
    + """SELECT id, CASE WHEN name = 'Cache' THEN 1.0 WHEN starts_with(lower(name), 'cache') THEN 0.9 WHEN contains(lower(name), 'cache') THEN 0.8 ELSE 0.7 END::DOUBLE AS score
    FROM n WHERE contains(lower(name), 'cache') OR contains(lower(qualified_name), 'cache')"""
)
def like_tiers(spark, d):
    return X.like_tiers(symbols(spark, d), "Cache").select("id", F.col("score").cast("double").alias("score"))


@query(
    C.WITH
    + """, near AS (SELECT name, levenshtein(lower(name), 'loggre') AS distance FROM (SELECT DISTINCT name FROM n) WHERE levenshtein(lower(name), 'loggre') <= 2),
    r AS (SELECT n.id, distance, row_number() OVER (PARTITION BY n.name ORDER BY file_path, start_line, id) AS rn FROM n JOIN near USING (name))
    SELECT id, distance FROM r WHERE rn <= 5"""
)
def fuzzy_names(spark, d):
    return X.fuzzy_names(symbols(spark, d), "loggre").select("id", F.col("distance").cast("long").alias("distance"))


@query(C.WITH + "SELECT id, name FROM n WHERE contains(lower(name), 'queue') AND NOT starts_with(lower(name), 'queue')")
def substring_lookup(spark, d):
    return X.substring_lookup(symbols(spark, d), "queue", True).select("id", "name")


@query(
    C.WITH
    + """, h AS (SELECT id, lower(name) AS low, file_path FROM n WHERE lower(name) IN ('logger', 'value', 'gettoken', 'init')),
    rare AS (SELECT low FROM h GROUP BY low HAVING count(DISTINCT file_path) < 10), good AS (SELECT DISTINCT file_path FROM h WHERE low IN (SELECT low FROM rare)),
    many AS (SELECT file_path FROM h GROUP BY file_path HAVING count(DISTINCT low) > 1)
    SELECT id, CASE WHEN file_path IN (SELECT file_path FROM good) AND file_path IN (SELECT file_path FROM many) THEN 21 ELSE 1 END AS score FROM h"""
)
def exact_names(spark, d):
    """Exact names; those that meet in one file count more."""
    return X.exact_names(symbols(spark, d), ["logger", "value", "getToken", "init"]).select("id", F.col("score").cast("int").alias("score"))


_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4, "property": 3,
    "field": 3, "variable": 2, "constant": 3, "import": 1, "export": 1, "namespace": 4, "protocol": 9, "enum_member": 3}.items())


@query(
    C.WITH
    + f"""SELECT id, CASE kind {_CASES} ELSE 0 END AS kind_bonus,
    CASE WHEN lower(name) = 'rendertoken' THEN 80 WHEN lower(name) IN ('render', 'token') THEN 60
         WHEN starts_with(lower(name), 'rendertoken') THEN CAST(floor(10.5 + 330.0 / length(name)) AS INT)
         WHEN contains(lower(name), 'render') AND contains(lower(name), 'token') THEN 15 WHEN contains(lower(name), 'rendertoken') THEN 10 ELSE 0 END AS name_bonus FROM n"""
)
def search_bonuses(spark, d):
    """What kind and name add to a score, for every symbol."""
    nodes = symbols(spark, d)
    return nodes.select("id", kind_bonus(F.col("kind")).alias("kind_bonus"), X.name_match_bonus(F.col("name"), "render token").alias("name_bonus"))


@query(
    C.WITH
    + r""", p AS (SELECT path, lower(path) AS low, regexp_extract(lower(path), '([^/]*)$', 1) AS file, regexp_extract(lower(path), '^(.*)/[^/]*$', 1) AS dir FROM f)
    SELECT path, CASE WHEN contains(file, 'cache') THEN 10 ELSE 0 END + CASE WHEN contains(dir, 'cache') THEN 5 WHEN contains(low, 'cache') THEN 3 ELSE 0 END
      + CASE WHEN contains(file, 'core') THEN 10 ELSE 0 END + CASE WHEN contains(dir, 'core') THEN 5 WHEN contains(low, 'core') THEN 3 ELSE 0 END
      - CASE WHEN regexp_matches(path, '(^|/)(test_|[Tt]est\.)[^/]*$|[._-]([Tt]ests?|[Ss]pecs?)\.[A-Za-z0-9]+$|(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$|/(tests?|__tests__|specs?|testlib|testing|ohostest)/|^(tests?|specs?)/|(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/')
             THEN 15 ELSE 0 END AS relevance FROM p"""
)
def path_relevance(spark, d):
    return C.files(spark, d).select("path", X.path_relevance(F.col("path"), "cache core").alias("relevance"))


@query()
def search_ranked(spark, d):
    """The whole ranked search with filters."""
    hits = X.search(symbols(spark, d), "render cache kind:function", 50, attached=C.sdk_nodes(spark, d))
    return hits.select("id", "name", "kind", "file_path", F.round("score", 6).alias("score"))


@query()
def search_spelling(spark, d):
    """A search that only near spellings answer."""
    hits = X.search(symbols(spark, d), "constructr", 50)
    return hits.select("id", "name", F.round("score", 6).alias("score"))


_MANY = r""", p AS (SELECT id, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS term FROM {docs}),
    post AS (SELECT term, id, count(*) AS f FROM p GROUP BY term, id), len AS (SELECT id, len(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+')) AS length FROM {docs}),
    asked AS ({asked}), ex AS (SELECT DISTINCT a.q, t.term FROM (SELECT DISTINCT q FROM asked) a JOIN (SELECT DISTINCT term FROM post) t ON {match}),
    hits AS (SELECT q, id, sum(f) AS f FROM post JOIN ex USING (term) GROUP BY q, id), df AS (SELECT q, count(*) AS df FROM hits GROUP BY q),
    part AS (SELECT q, id, greatest(ln(((SELECT count(*) FROM len) - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM len))) AS s
             FROM hits JOIN df USING (q) JOIN len USING (id)),
    sc AS (SELECT query_id, id, sum(s) AS score FROM asked JOIN part USING (q) GROUP BY query_id, id)"""


@query(
    C.WITH
    + _MANY.format(text="name", docs="n", asked=r"SELECT DISTINCT id AS query_id, unnest(regexp_extract_all(lower(reference_name), '[\p{L}\p{N}]+')) AS q FROM unresolved_refs WHERE id % 50 = 0", match="starts_with(t.term, a.q)")
    + " SELECT query_id, count(*) AS n_hits, round(max(score), 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10 GROUP BY query_id"
)
def search_references(spark, d):
    """For every fiftieth unresolved reference, its ten best symbols by prefix (number and best score)."""
    post, lengths = X.postings(staged(symbols(spark, d).select("id", "name"), "names"), "id", {"name": 1.0})
    refs = table(spark, d, "unresolved_refs").where("id % 50 = 0")
    asked = refs.select(F.col("id").alias("query_id"), F.explode(X.tokens(F.col("reference_name"))).alias("term"))
    best = X.bm25_many(post, lengths, asked, 10)
    return best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.max("score"), 6).alias("best"))


@query(
    "WITH docs AS (SELECT doc_id AS id, text FROM documents)"
    + _MANY.format(text="text", docs="docs", asked=r"SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(regexp_extract(text, '^[^\n]*')), '[\p{L}\p{N}]+')) AS q FROM documents WHERE doc_id % 50 = 0", match="t.term = a.q")
    + " SELECT query_id, count(*) AS n_hits, round(max(score), 6) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10 GROUP BY query_id"
)
def search_documents(spark, d):
    """For the headline of every document whose id 50 divides, the ten best documents (number and best score)."""
    docs = table(spark, d, "documents")
    post, lengths = X.postings(docs, "doc_id", {"text": 1.0})
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(X.tokens(F.regexp_extract("text", r"^[^\n]*", 0))).alias("term"))
    best = X.bm25_many(post, lengths, asked, 10, prefix=False)
    return best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.max("score"), 6).alias("best"))


_SEGMENTS = r""", nm AS (SELECT DISTINCT name FROM n), sg AS (SELECT name, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'),
    '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '[\p{L}\p{N}]+'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 32 AND NOT regexp_matches(x, '^\p{N}+$')) AS s FROM nm),
    v AS (SELECT DISTINCT name, unnest(s) AS segment FROM sg)"""


@query(C.WITH + _SEGMENTS + " SELECT segment, name FROM v")
def segment_vocab(spark, d):
    return X.segment_vocabulary(symbols(spark, d))


@query(C.WITH + _SEGMENTS + " SELECT segment, count(*) AS n_names FROM v GROUP BY segment HAVING count(*) BETWEEN 2 AND 25")
def segment_rarity(spark, d):
    """Words that few names share."""
    return X.segment_vocabulary(symbols(spark, d)).groupBy("segment").agg(F.count(F.lit(1)).alias("n_names")).where("n_names between 2 and 25")


_STOPS = ", ".join(f"'{w}'" for w in sorted(X.PROSE_STOP_WORDS))


@query(
    C.WITH
    + _SEGMENTS
    + rf""", wd AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+')) AS word FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
    ok AS (SELECT query_id, word FROM wd WHERE length(word) BETWEEN 4 AND 24 AND NOT regexp_matches(word, '^\p{{N}}+$') AND word NOT IN ({_STOPS})),
    va AS (SELECT query_id, word, word AS segment FROM ok
      UNION SELECT query_id, word, left(word, -2) FROM ok WHERE regexp_matches(word, '(x|sh|ss|zz|ch|s|z|o)es$') AND length(word) >= 6
      UNION SELECT query_id, word, left(word, -1) FROM ok WHERE length(word) >= 5 AND NOT regexp_matches(word, '(x|sh|ss|zz)es$') AND ends_with(word, 's') AND NOT ends_with(word, 'ss'))
    SELECT query_id, name, count(DISTINCT word) AS n_words FROM v JOIN va USING (segment) GROUP BY query_id, name HAVING count(DISTINCT word) >= 2"""
)
def segment_cooccurrence(spark, d):
    """Names that hold two words or more of a document whose id 50 divides."""
    chats = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text"))
    asked = chats.select("query_id", F.explode(X.prose_words(F.col("text"))).alias("word"))
    return X.segment_matches(X.segment_vocabulary(symbols(spark, d)), asked)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS n_cjk FROM documents WHERE regexp_matches(text, '[一-鿿]')")
def cjk_terms(spark, d):
    """Ideographs per document after they are spaced into terms of their own."""
    docs = table(spark, d, "documents").where(F.col("text").rlike("[一-鿿]"))
    found = F.regexp_extract_all(cjk_spaced(F.col("text")), F.lit(r"(?<![一-鿿])[一-鿿](?![一-鿿])"), F.lit(0))
    return docs.select("doc_id", F.size(found).cast("long").alias("n_cjk"))


@query(C.WITH + _SEGMENTS + " SELECT least(len(list_distinct(s)), 12) AS n_segments, count(*) AS n_names FROM sg GROUP BY 1")
def segment_histogram(spark, d):
    names = symbols(spark, d).select("name").distinct()
    return names.groupBy(F.size(segments(F.col("name"))).cast("long").alias("n_segments")).agg(F.count(F.lit(1)).alias("n_names"))
