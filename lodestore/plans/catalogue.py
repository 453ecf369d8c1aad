"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extraction, ranking, text, vectors
from ..operators import catalog, forget, graph, recall, retrieval, writes
from ..operators.filters import MemoryFilter, for_listing
from ..operators.recall import RecallOptions
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW, EPOCH, DAY = fx.NOW, fx.EPOCH, fx.DAY
WORDS = ("thing", "erint")
QUERY = " ".join(WORDS)
K, FETCH = 20, recall.fetch_k(20)


def sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([fx.SQL, *more]) + "\n" + body


def query(oracle: str | None = None, *more: str):
    """Registers a query under its name, with its SQL over the fixtures' tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *more)
        return f

    return add


def _md5(text_: str) -> str:
    return hashlib.md5(text_.encode()).hexdigest()


def r6(c):
    return F.round(c, 6)


# ---- catalogue and filters ----


@query("SELECT uuid, content_hash, source, importance, access_count, last_accessed, created_at, expires_at, status, array_to_string(tags, ',') AS tags FROM mem WHERE uuid = md5('m:7')")
def get_memory(spark, sf):
    rows = catalog.get_memory(fx.state(spark, sf), _md5("m:7"))
    return rows.select("uuid", "content_hash", "source", "importance", "access_count", "last_accessed", "created_at", "expires_at", "status", F.array_join("tags", ",").alias("tags"))


@query("SELECT uuid, created_at, status, array_to_string(tags, ',') AS tags FROM (SELECT * FROM mem WHERE status <> 'deleted' ORDER BY created_at DESC, id LIMIT 100 OFFSET 20)")
def list_memories(spark, sf):
    return catalog.list_memories(fx.state(spark, sf), limit=100, offset=20).select("uuid", "created_at", "status", F.array_join("tags", ",").alias("tags"))


FILTERS = {
    "filter_status": (MemoryFilter(status_in=["archived", "expired"]), "status IN ('archived', 'expired')"),
    "filter_source": (MemoryFilter(source_in=["user", "tool"]), "status <> 'deleted' AND source IN ('user', 'tool')"),
    "filter_time_range": (MemoryFilter(created_after=EPOCH + 10 * DAY, created_before=EPOCH + 30 * DAY), f"status <> 'deleted' AND created_at > {EPOCH + 10 * DAY} AND created_at < {EPOCH + 30 * DAY}"),
    "filter_importance": (MemoryFilter(importance_min=0.2, importance_max=0.5), "status <> 'deleted' AND importance >= 0.2::DOUBLE AND importance <= 0.5::DOUBLE"),
    "filter_access": (MemoryFilter(access_count_lt=60), "status <> 'deleted' AND access_count < 60"),
    "filter_staleness": (MemoryFilter(last_accessed_before=EPOCH + 25 * DAY, last_accessed_after=EPOCH + 5 * DAY), f"status <> 'deleted' AND coalesce(last_accessed, created_at) < {EPOCH + 25 * DAY} AND coalesce(last_accessed, created_at) > {EPOCH + 5 * DAY}"),
    "filter_tags_all": (MemoryFilter(tags_all=["en", "toxic", "en"], importance_min=0.1), "status <> 'deleted' AND importance >= 0.1::DOUBLE AND list_has_all(tags, ['en', 'toxic'])"),
    "filter_tags_any": (MemoryFilter(tags_any=["de", "toxic"]), "status <> 'deleted' AND list_has_any(tags, ['de', 'toxic'])"),
}


def _add_filters() -> None:
    for name, (f, where) in FILTERS.items():
        QUERIES[name] = lambda spark, sf, f=f: for_listing(fx.state(spark, sf), f).select("id", "uuid", "status", "source", "importance")
        ORACLE_SQL[name] = sql(f"SELECT id, uuid, status, source, importance FROM mem WHERE {where}")


_add_filters()


@query("SELECT count(*) AS n FROM mem WHERE status <> 'deleted' AND importance >= 0.5::DOUBLE AND list_has_all(tags, ['en'])")
def count_filter(spark, sf):
    return catalog.count_memories(fx.state(spark, sf), MemoryFilter(importance_min=0.5, tags_all=["en"]))


@query("SELECT tag, count(*) AS memory_count FROM mtags GROUP BY tag")
def tag_counts(spark, sf):
    return catalog.tag_counts(fx.state(spark, sf))


@query("SELECT tag FROM mtags WHERE memory_uuid = md5('m:16')")
def tags_of_memory(spark, sf):
    return catalog.tags_of_memory(fx.state(spark, sf), _md5("m:16"))


@query("""SELECT (SELECT count(*) FROM mem WHERE status = 'active') AS active, (SELECT count(*) FROM mem WHERE status = 'archived') AS archived, (SELECT count(*) FROM mem WHERE status <> 'deleted') AS total,
(SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM emb) AS vectors, (SELECT count(DISTINCT tag) FROM mtags) AS tags""")
def stats(spark, sf):
    return catalog.stats(fx.state(spark, sf))


@query("SELECT uuid, name, type, updated_at FROM ent WHERE uuid = md5('nation:3')")
def entity_lookup(spark, sf):
    return catalog.entity(fx.state(spark, sf), _md5("nation:3")).select("uuid", "name", "type", "updated_at")


@query("SELECT uuid, source_uuid, target_uuid, predicate, confidence FROM rel WHERE uuid = md5('r:' || md5('nation:3') || ':in_region:' || (SELECT md5('region:' || n_regionkey) FROM nation WHERE n_nationkey = 3))")
def relation_lookup(spark, sf):
    s = fx.state(spark, sf)
    one = catalog.list_outgoing(s, _md5("nation:3"), "in_region", 1).first()
    return catalog.relation(s, one["uuid"]).select("uuid", "source_uuid", "target_uuid", "predicate", "confidence")


@query("SELECT uuid, name, type, updated_at FROM ent WHERE starts_with(lower(name), 'red') AND type = 'part' ORDER BY updated_at DESC, uuid LIMIT 100")
def list_entities(spark, sf):
    return catalog.list_entities(fx.state(spark, sf), "Red", "part").select("uuid", "name", "type", "updated_at")


@query("SELECT uuid, target_uuid, predicate, confidence FROM rel WHERE source_uuid = md5('part:1') AND predicate = 'supplied_by' ORDER BY confidence DESC, uuid LIMIT 100")
def list_outgoing(spark, sf):
    return catalog.list_outgoing(fx.state(spark, sf), _md5("part:1"), "supplied_by").select("uuid", "target_uuid", "predicate", "confidence")


@query("SELECT uuid, source_uuid, predicate, confidence FROM rel WHERE target_uuid = md5('supplier:1') ORDER BY confidence DESC, uuid LIMIT 100")
def list_incoming(spark, sf):
    return catalog.list_incoming(fx.state(spark, sf), _md5("supplier:1")).select("uuid", "source_uuid", "predicate", "confidence")


@query("SELECT uuid, source_uuid, target_uuid, predicate FROM rel WHERE source_uuid IN (SELECT uuid FROM ent ORDER BY updated_at DESC, uuid LIMIT 50) ORDER BY uuid DESC LIMIT 500")
def list_relations(spark, sf):
    return catalog.list_relations(fx.state(spark, sf), limit=500).select("uuid", "source_uuid", "target_uuid", "predicate")


# ---- scalar functions over whole tables ----


@query("SELECT uuid, content_hash, substring(content, 1, 90) AS snippet FROM mem")
def content_hash(spark, sf):
    return fx.memory(spark, sf).select("uuid", text.content_hash(F.col("content")).alias("content_hash"), text.snippet(F.col("content")).alias("snippet"))


TOKENS = "tok AS (SELECT uuid, id, status, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}_]+') AS t FROM mem)"


@query("SELECT uuid, md5(array_to_string(t, ' ')) AS tokens_md5, len(t)::BIGINT AS n FROM tok", TOKENS)
def tokenize(spark, sf):
    t = fx.memory(spark, sf).select("uuid", text.tokens(F.col("content")).alias("t"))
    return t.select("uuid", F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.size("t").cast("long").alias("n"))


@query("SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens, round(avg(len(t)), 6) AS avgdl FROM tok", TOKENS)
def postings_stats(spark, sf):
    return retrieval.postings_stats(fx.memory(spark, sf)).withColumn("avgdl", r6("avgdl"))


@query("SELECT term, count(DISTINCT uuid) AS df, count(*) AS cf FROM (SELECT uuid, unnest(t) AS term FROM tok) GROUP BY term", TOKENS)
def postings(spark, sf):
    return retrieval.postings(fx.memory(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("SELECT uuid, round(sqrt(least(greatest(access_count, 0), 50) / 50.0), 6) AS access_signal FROM mem")
def access_signal(spark, sf):
    return fx.memory(spark, sf).select("uuid", r6(ranking.access_signal(F.col("access_count"))).alias("access_signal"))


@query("SELECT uuid, array_to_string(list_distinct_ordered, ',') AS merged FROM (SELECT uuid, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS list_distinct_ordered FROM (SELECT uuid, list_concat(tags, [source, tags[1], 'new']) AS raw FROM mem))")
def merge_tags(spark, sf):
    more = F.array(F.concat(F.lit("  "), F.col("source")), F.concat(F.get("tags", F.lit(0)), F.lit("\t")), F.lit(" "), F.lit("new"))
    return fx.memory(spark, sf).select("uuid", F.array_join(text.merge_tags(F.col("tags"), more), ",").alias("merged"))


@query("SELECT a.memory_uuid AS a, b.memory_uuid AS b, round(list_cosine_similarity(a.vector, b.vector), 6) AS cosine FROM emb a JOIN (SELECT * FROM emb WHERE memory_uuid IN (md5('m:0'), md5('m:1'))) b ON true")
def cosine_pairs(spark, sf):
    e = fx.state(spark, sf).embeddings.select("memory_uuid", "vector")
    two = e.where(F.col("memory_uuid").isin(_md5("m:0"), _md5("m:1")))
    pairs = e.select(F.col("memory_uuid").alias("a"), F.col("vector").alias("x")).crossJoin(F.broadcast(two.select(F.col("memory_uuid").alias("b"), F.col("vector").alias("y"))))
    return pairs.select("a", "b", r6(vectors.cosine(F.col("x"), F.col("y"))).alias("cosine"))


@query("SELECT a.memory_uuid AS a, b.memory_uuid AS b, round(list_cosine_similarity(a.vector, b.vector), 6) AS cosine FROM emb a JOIN (SELECT * FROM emb WHERE memory_uuid IN (SELECT md5('m:' || vec_id) FROM embeddings WHERE vec_id % 50 = 0)) b ON true")
def cosine_pairs_every_50th(spark, sf):
    e = fx.embeddings(spark, sf)
    ids = fx.table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(fx._uuid("m", F.col("vec_id").cast("string")).alias("memory_uuid"))
    some = e.join(ids, "memory_uuid", "left_semi")
    pairs = retrieval.cosine_pairs(e, some.select(F.col("memory_uuid").alias("query_id"), F.col("vector").alias("query")))
    return pairs.select(F.col("uuid").alias("a"), F.col("query_id").alias("b"), r6("cosine").alias("cosine"))


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM embeddings")
def vector_validate(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", vectors.valid(F.col("embedding"), 64).alias("ok"))


def _mock_sql(dims: int) -> str:
    byte = "list_transform(range(1, strlen(content) + 1), lambda i: ('0x' || hex_text[2 * i - 1 : 2 * i])::BIGINT)"
    start = f"(xor({vectors.OFFSET}, d) * {vectors.PRIME}) % {vectors.MOD}"
    step = f"(xor(h, b) * {vectors.PRIME}) % {vectors.MOD}"
    values = f"list_transform(range(0, {dims}), lambda d: round(greatest(-1.0, least(1.0, list_reduce(codes, lambda h, b: {step}, {start}) / 2147483648.0 - 1)), 6))"
    return f"SELECT uuid, array_to_string({values}, ' ') AS embedding FROM (SELECT uuid, {byte} AS codes FROM (SELECT uuid, content, hex(encode(content)) AS hex_text FROM ptext))"


@query("SELECT uuid, round(list_aggregate(v, 'sum'), 6) AS total, round(v[1], 6) AS first, round(v[64], 6) AS last FROM (" + _mock_sql(64).replace("round(greatest", "(greatest").replace(", 6))", "))").replace("array_to_string(", "(").replace(", ' ')", ")").replace("AS embedding", "AS v") + ")")
def mock_embedding(spark, sf):
    e = fx.part_texts(spark, sf).select("uuid", vectors.mock_embedding(F.col("content"), 64).alias("v"))
    return e.select("uuid", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(F.get("v", F.lit(0))).alias("first"), r6(F.get("v", F.lit(63))).alias("last"))


@query()
def mock_embedding_memory(spark, sf):
    """Of all memory contents, whole. It has no SQL."""
    e = fx.memory(spark, sf).select("uuid", vectors.mock_embedding(F.col("content"), 64).alias("v"))
    return e.select("uuid", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(F.get("v", F.lit(0))).alias("first"), r6(F.get("v", F.lit(63))).alias("last"))


@query("SELECT uuid, p_brand || ':wiki:brand,' || p_type || ':wiki' AS links FROM ptext")
def extract_wikilinks(spark, sf):
    links = F.transform(extraction.wikilinks(F.col("content")), lambda e: F.concat_ws(":", e["name"], e["type"]))
    return fx.part_texts(spark, sf).select("uuid", F.array_join(links, ",").alias("links"))


@query("SELECT uuid, lower(p_type) AS tags FROM ptext")
def extract_hashtags(spark, sf):
    return fx.part_texts(spark, sf).select("uuid", F.array_join(extraction.hashtags(F.col("content")), ",").alias("tags"))


_OPENERS = ", ".join(f"'{w}'" for w in extraction.OPENERS)
CAPITALS = f"""caps AS (SELECT uuid, list_filter(regexp_extract_all(content, '(?:^|[^A-Za-z0-9])([A-Z][A-Za-z.'']*(?: [A-Z][A-Za-z.'']*)*)', 1), lambda n: length(n) >= 2 AND n NOT IN ({_OPENERS})) AS raw FROM mem),
names AS (SELECT uuid, list_filter(raw, lambda n, i: list_position(raw, n) = i) AS names FROM caps)"""


@query("SELECT uuid, len(names)::BIGINT AS n, md5(array_to_string(names, '|')) AS names_md5 FROM names", CAPITALS)
def extract_entities(spark, sf):
    names = fx.memory(spark, sf).select("uuid", F.transform(extraction.entities(F.col("content")), lambda e: e["name"]).alias("names"))
    return names.select("uuid", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", "|")).alias("names_md5"))


MENTIONS = """pe AS (SELECT uuid, unnest([p_brand, p_type, 'Acme Corp']) AS name, unnest(['wiki:brand', 'wiki', 'unknown']) AS type, unnest([0, 1, 2]) AS pos FROM ptext),
pairs AS (SELECT a.uuid, a.name AS source_name, b.name AS target_name FROM pe a JOIN pe b ON a.uuid = b.uuid AND a.pos < b.pos AND a.name <> b.name)"""
# the text's capitalised runs: 'Brand' in '[[Brand#' and the type are found as runs too
MENTIONS = MENTIONS.replace("[p_brand, p_type, 'Acme Corp']", "names").replace("['wiki:brand', 'wiki', 'unknown']", "kinds").replace("unnest([0, 1, 2])", "generate_subscripts(names, 1)").replace("FROM ptext)", """FROM (SELECT uuid, list_filter(raw, lambda n, i: list_position(raw, n) = i) AS names, list_filter(kinds0, lambda k, i: list_position(raw, raw[i]) = i) AS kinds FROM (
  SELECT uuid, list_concat([p_brand, p_type], caps) AS raw, list_concat(['wiki:brand', 'wiki'], list_transform(caps, lambda c: 'unknown')) AS kinds0 FROM (
  SELECT uuid, p_brand, p_type, list_filter(regexp_extract_all(content, '(?:^|[^A-Za-z0-9])([A-Z][A-Za-z.'']*(?: [A-Z][A-Za-z.'']*)*)', 1), lambda n: length(n) >= 2 AND n NOT IN (OPENERS)) AS caps FROM ptext))))""".replace("OPENERS", _OPENERS))


@query("SELECT uuid, source_name, target_name, 'mentions' AS predicate, 0.3::DOUBLE AS confidence FROM pairs", MENTIONS)
def cooccurrence(spark, sf):
    found = writes.extracted(fx.part_texts(spark, sf), "uuid")
    return writes.mentions(found, "uuid").select("uuid", "source_name", "target_name", "predicate", "confidence")


@query("SELECT uuid, source_name, target_name FROM pairs WHERE 0.3 >= 0.3", MENTIONS)
def link_min_conf(spark, sf):
    found = writes.extracted(fx.part_texts(spark, sf), "uuid")
    return writes.mentions(found, "uuid").where(F.col("confidence") >= 0.3).select("uuid", "source_name", "target_name")


@query("SELECT source_uuid, predicate, target_uuid, round(max(confidence), 6) AS confidence FROM (SELECT md5('part:' || l_partkey) AS source_uuid, 'supplied_by' AS predicate, md5('supplier:' || l_suppkey) AS target_uuid, round(1 - l_discount, 6) AS confidence FROM lineitem) GROUP BY ALL")
def relation_dedup(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), fx._uuid("part", F.col("l_partkey").cast("string")).alias("source_uuid"), F.lit("supplied_by").alias("predicate"), fx._uuid("supplier", F.col("l_suppkey").cast("string")).alias("target_uuid"), r6(1 - F.col("l_discount")).alias("confidence"))
    return writes.best_relations(rows, "source_uuid", "predicate", "target_uuid").select("source_uuid", "predicate", "target_uuid", r6("confidence").alias("confidence"))


# ---- retrieval ----

SEMANTIC = f"""qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
allsem AS (SELECT memory_uuid AS uuid, greatest(-1.0, least(1.0, list_cosine_similarity(vector, q))) AS cosine FROM emb, qv),
sem AS (SELECT * FROM allsem ORDER BY round(cosine, 9) DESC, uuid LIMIT {FETCH})"""


def _idf(i: int) -> str:
    return f"(CASE WHEN ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)))"


KEYWORD = (
    TOKENS
    + f""",
freq AS (SELECT uuid, id, status, len(t) AS dl, {", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) AS f{i}" for i, w in enumerate(WORDS))} FROM tok),
totals AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(WORDS)))} FROM freq),
allkw AS (SELECT uuid, id, status, -({" + ".join(map(_idf, range(len(WORDS))))}) AS bm25 FROM freq, totals WHERE {" AND ".join(f"f{i} > 0" for i in range(len(WORDS)))}),
kw0 AS (SELECT uuid, id, bm25 FROM allkw WHERE status = 'active' ORDER BY round(bm25, 9), id LIMIT {FETCH}),
kw AS (SELECT uuid, id, bm25, CASE WHEN max(bm25) OVER () - min(bm25) OVER () <= 0 THEN 1.0 ELSE 1 - (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS score FROM kw0)"""
)


@query("SELECT uuid, round(cosine, 6) AS cosine FROM sem", SEMANTIC)
def knn_topk(spark, sf):
    return retrieval.knn(fx.state(spark, sf).embeddings, fx.query_vector(spark, sf), FETCH).select("uuid", r6("cosine").alias("cosine"))


@query("SELECT uuid, round(cosine, 6) AS cosine FROM allsem WHERE cosine >= 0.1 ORDER BY round(cosine, 9) DESC, uuid LIMIT 500", SEMANTIC)
def knn_threshold(spark, sf):
    return retrieval.knn(fx.state(spark, sf).embeddings, fx.query_vector(spark, sf), 500, 0.1).select("uuid", r6("cosine").alias("cosine"))


@query("""SELECT query_id, uuid, round(cosine, 6) AS cosine, rank FROM (SELECT query_id, memory_uuid AS uuid, list_cosine_similarity(vector, q) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector, q), 9) DESC, memory_uuid) AS rank
FROM emb, (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 8)) WHERE rank <= 10""")
def knn_batch(spark, sf):
    queries = fx.table(spark, sf, "embeddings").where("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.knn_batch(fx.state(spark, sf).embeddings, queries, 10).select("query_id", "uuid", r6("cosine").alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT query_id, uuid, round(cosine, 6) AS cosine, rank FROM (SELECT query_id, memory_uuid AS uuid, list_cosine_similarity(vector, q) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector, q), 9) DESC, memory_uuid) AS rank
FROM emb, (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)) WHERE rank <= 10""")
def knn_batch_every_50th(spark, sf):
    queries = fx.table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.knn_batch(fx.embeddings(spark, sf), queries, 10).select("query_id", "uuid", r6("cosine").alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT uuid, round(greatest(-1.0, least(1.0, 1 - d * d / 2)), 6) AS cosine FROM (SELECT memory_uuid AS uuid, list_distance(list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))), list_transform(q, lambda x: x / sqrt(list_dot_product(q, q)))) AS d FROM emb, qv) ORDER BY round(d, 9), uuid LIMIT {K}""", SEMANTIC)
def knn_l2(spark, sf):
    q = fx.query_vector(spark, sf)
    norm = sum(x * x for x in q) ** 0.5
    unit = F.transform("vector", lambda x: x / F.sqrt(vectors.dot(F.col("vector"), F.col("vector"))))
    d = fx.state(spark, sf).embeddings.select(F.col("memory_uuid").alias("uuid"), vectors.l2(unit, F.array(*(F.lit(x / norm) for x in q))).alias("d"))
    return d.orderBy(F.round("d", 9), "uuid").limit(K).select("uuid", r6(vectors.l2_to_cosine(F.col("d"))).alias("cosine"))


@query()
def knn_ann(spark, sf):
    return retrieval.knn_ann(fx.state(spark, sf).embeddings, fx.query_vector(spark, sf), 10).select("uuid", r6("cosine").alias("cosine"))


def _bm25(spark, sf, **options):
    return retrieval.bm25(fx.memory(spark, sf).drop("tags"), QUERY, FETCH, index=fx.postings(spark, sf), **options)


@query("SELECT uuid, round(bm25, 6) AS bm25 FROM kw", KEYWORD)
def bm25_topk(spark, sf):
    return _bm25(spark, sf).select("uuid", r6("bm25").alias("bm25"))


@query("SELECT uuid, round(score, 6) AS score FROM kw", KEYWORD)
def bm25_norm(spark, sf):
    return _bm25(spark, sf).select("uuid", r6("score").alias("score"))


@query(f"SELECT uuid, round(bm25, 6) AS bm25 FROM allkw WHERE status IN ('archived', 'expired') ORDER BY round(bm25, 9), id LIMIT {FETCH}", KEYWORD)
def bm25_status(spark, sf):
    return _bm25(spark, sf, statuses=["archived", "expired"]).select("uuid", r6("bm25").alias("bm25"))


FUSED = """arms AS (SELECT uuid, row_number() OVER (ORDER BY round(cosine, 9) DESC, uuid) AS rank, 'semantic' AS label, 0.6 AS w FROM sem UNION ALL SELECT uuid, row_number() OVER (ORDER BY round(bm25, 9), id), 'keyword', 0.3 FROM kw),
wsum AS (SELECT sum(w) AS total FROM (SELECT DISTINCT label, w FROM arms)),
fused AS (SELECT uuid, sum(w / total / (25 + rank)) AS rrf, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM arms, wsum GROUP BY uuid)"""


@query("SELECT uuid, round(rrf, 6) AS rrf, labels FROM fused", SEMANTIC, KEYWORD, FUSED)
def rrf_fusion(spark, sf):
    s = fx.state(spark, sf)
    near, found = retrieval.knn(s.embeddings, fx.query_vector(spark, sf), FETCH), retrieval.bm25(s.memory, QUERY, FETCH, index=s.postings)
    arms = retrieval.ranked(near, "semantic", 0.6, F.desc(F.round("cosine", 9)), "uuid").unionByName(retrieval.ranked(found, "keyword", 0.3, F.round("bm25", 9), "id"))
    return retrieval.rrf(arms).select("uuid", r6("rrf").alias("rrf"), F.array_join("labels", ",").alias("labels"))


def _score(cosine: str, graph_: str = "0") -> str:
    unit = f"CASE WHEN {cosine} IS NULL OR {cosine} <= -1 THEN 0 WHEN {cosine} >= 1 THEN 1 ELSE ({cosine} + 1) / 2 END"
    return f"least(1.0, greatest(0.0, 0.6 * ({unit}) + 0.15 * importance + 0.1 * sqrt(least(access_count, 50) / 50.0) + 0.15 * ({graph_})))"


def _hits(candidates: str, where: str = "status = 'active'", limit: int = K) -> str:
    return f"""SELECT uuid, round(cosine, 6) AS cosine, from_graph, round(score, 6) AS score FROM (SELECT mem.uuid, created_at, cosine, from_graph, {_score("cosine", "CASE WHEN from_graph THEN 1 ELSE 0 END")} AS score
FROM mem JOIN ({candidates}) c ON c.uuid = mem.uuid WHERE {where}) ORDER BY round(score, 9) DESC, created_at DESC, uuid LIMIT {limit}"""


def _recall(spark, sf, **options):
    s = fx.state(spark, sf)
    return recall.recall(s, QUERY, fx.query_vector(spark, sf), RecallOptions(**options)).select("uuid", r6("cosine").alias("cosine"), "from_graph", r6("score").alias("score"))


@query(_hits("SELECT uuid, cosine, false AS from_graph FROM sem"), SEMANTIC)
def recall_semantic(spark, sf):
    return _recall(spark, sf, mode="semantic")


@query(_hits("SELECT uuid, 2 * score - 1 AS cosine, false AS from_graph FROM kw"), KEYWORD)
def recall_keyword(spark, sf):
    return _recall(spark, sf, mode="keyword")


HYBRID = "cand AS (SELECT f.uuid, coalesce(sem.cosine, 2 * kw.score - 1) AS cosine, false AS from_graph FROM (SELECT uuid FROM fused ORDER BY round(rrf, 12) DESC, uuid LIMIT 60) f LEFT JOIN sem USING (uuid) LEFT JOIN kw USING (uuid))"


@query(_hits("SELECT * FROM cand"), SEMANTIC, KEYWORD, FUSED, HYBRID)
def recall_hybrid(spark, sf):
    return _recall(spark, sf, mode="hybrid")


@query("SELECT count(*) AS total_candidates FROM mem JOIN cand USING (uuid) WHERE status = 'active' AND importance >= 0.5::DOUBLE", SEMANTIC, KEYWORD, FUSED, HYBRID)
def recall_total(spark, sf):
    return recall.total_candidates(fx.state(spark, sf), QUERY, fx.query_vector(spark, sf), RecallOptions(filter=MemoryFilter(importance_min=0.5)))


@query(f"SELECT uuid, round(s, 6) AS score FROM (SELECT mem.uuid, {_score('cosine')} AS s FROM mem JOIN allsem ON allsem.uuid = mem.uuid)", SEMANTIC)
def rank_linear(spark, sf):
    return _ranked(spark, sf, 0.0)


@query(f"SELECT uuid, round(s, 6) AS score FROM (SELECT mem.uuid, {_score('cosine')} AS s FROM mem JOIN allsem ON allsem.uuid = mem.uuid) WHERE s >= 0.45", SEMANTIC)
def rank_threshold(spark, sf):
    return _ranked(spark, sf, 0.45)


def _ranked(spark, sf, threshold):
    s = fx.state(spark, sf)
    near = s.embeddings.select(F.col("memory_uuid").alias("uuid"), vectors.cosine_to(F.col("vector"), fx.query_vector(spark, sf)).alias("cosine"))
    rows = s.memory.join(near, "uuid").withColumn("from_graph", F.lit(False))
    return retrieval.rank_linear(rows, threshold=threshold).select("uuid", r6("score").alias("score"))


@query("SELECT mem.uuid, round(0.6 * CASE WHEN cosine IS NULL OR cosine <= -1 THEN 0 WHEN cosine >= 1 THEN 1 ELSE (cosine + 1) / 2 END, 6) AS similarity, round(0.15 * importance, 6) AS importance, round(0.1 * sqrt(least(access_count, 50) / 50.0), 6) AS access, CASE WHEN id % 2 = 0 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS graph_boost FROM mem JOIN allsem ON allsem.uuid = mem.uuid", SEMANTIC)
def score_components(spark, sf):
    s = fx.state(spark, sf)
    near = s.embeddings.select(F.col("memory_uuid").alias("uuid"), vectors.cosine_to(F.col("vector"), fx.query_vector(spark, sf)).alias("cosine"))
    rows = retrieval.rank_linear(s.memory.join(near, "uuid").withColumn("from_graph", F.col("id") % 2 == 0))
    return rows.select("uuid", *[r6(f"components.{c}").alias(c) for c in ("similarity", "importance", "access", "graph_boost")])


# ---- graph ----

NATION = "nation:3"


def _start(spark, name=NATION):
    return spark.createDataFrame([(_md5(name),)], "uuid string")


@query("SELECT u AS uuid, min(d)::INT AS depth FROM walk GROUP BY u", f"walk(u, d) AS (SELECT md5('{NATION}'), 0 UNION SELECT v, d + 1 FROM walk JOIN adj USING (u) WHERE d < 3)")
def bfs_depth(spark, sf):
    return graph.bfs_depth(fx.relations(spark, sf), _start(spark), 3)


@query("SELECT u AS uuid, min(d)::INT AS depth FROM walk GROUP BY u", f"walk(u, d) AS (SELECT md5('{NATION}'), 0 UNION SELECT v, d + 1 FROM walk JOIN (SELECT a.* FROM adj a JOIN rel ON rel.uuid = a.edge WHERE predicate IN ('in_region', 'located_in') AND confidence >= 0.9::DOUBLE) USING (u) WHERE d < 3)")
def bfs_whitelist(spark, sf):
    return graph.bfs_depth(fx.relations(spark, sf), _start(spark), 3, whitelist=["in_region", "located_in"], min_confidence=0.9)


PATHS = f"""l0 AS (SELECT md5('{NATION}') AS uuid, 0 AS depth, 0 AS position, md5('{NATION}') AS path),
l1 AS (SELECT v AS uuid, 1 AS depth, row_number() OVER (ORDER BY key) AS position, (SELECT path FROM l0) || '>' || v AS path FROM (SELECT v, min((dir, edge)) AS key FROM adj JOIN l0 ON u = l0.uuid GROUP BY v) WHERE v NOT IN (SELECT uuid FROM l0) ORDER BY key LIMIT 199),
l2 AS (SELECT v AS uuid, 2 AS depth, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY key) AS position, path || '>' || v AS path FROM (SELECT v, min((position, dir, edge)) AS key, arg_min(path, (position, dir, edge)) AS path FROM adj JOIN l1 ON u = l1.uuid GROUP BY v)
  WHERE v NOT IN (SELECT uuid FROM l0 UNION SELECT uuid FROM l1) ORDER BY key LIMIT (SELECT 199 - count(*) FROM l1))"""


@query("SELECT uuid, depth::INT AS depth, position::INT AS position, path FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)", PATHS)
def bfs_path(spark, sf):
    start = _md5(NATION)
    found = graph.traverse(fx.relations(spark, sf), start, 2, 200)
    return found.select("uuid", "depth", F.col("position").cast("int").alias("position"), F.array_join("path", ">").alias("path"))


EXPANDED = f"""seeds AS (SELECT uuid FROM sem),
sents AS (SELECT source_uuid AS u FROM rel WHERE memory_uuid IN (SELECT uuid FROM seeds) UNION SELECT target_uuid FROM rel WHERE memory_uuid IN (SELECT uuid FROM seeds)),
nodes AS (SELECT u FROM sents UNION SELECT v FROM adj WHERE u IN (SELECT u FROM sents)),
near AS (SELECT uuid FROM (SELECT memory_uuid AS uuid FROM rel WHERE memory_uuid IS NOT NULL AND (source_uuid IN (SELECT u FROM nodes) OR target_uuid IN (SELECT u FROM nodes)) UNION SELECT uuid FROM seeds) ORDER BY uuid LIMIT {FETCH})"""


def _seeds(spark, sf):
    return retrieval.knn(fx.state(spark, sf).embeddings, fx.query_vector(spark, sf), FETCH).select("uuid")


@query("SELECT u AS uuid FROM sents", SEMANTIC, EXPANDED)
def graph_seed_entities(spark, sf):
    return graph.seed_entities(fx.relations(spark, sf), _seeds(spark, sf))


@query("SELECT uuid FROM near", SEMANTIC, EXPANDED)
def graph_expand(spark, sf):
    return graph.expand(fx.state(spark, sf), _seeds(spark, sf), 1, FETCH)


@query(_hits("SELECT uuid, cosine, uuid IN (SELECT uuid FROM near) AS from_graph FROM sem UNION ALL SELECT uuid, NULL, true FROM near WHERE uuid NOT IN (SELECT uuid FROM sem)"), SEMANTIC, EXPANDED)
def recall_graph(spark, sf):
    return _recall(spark, sf, mode="semantic", graph_depth=1)


@query("SELECT uuid, name FROM ent WHERE type = 'unknown' AND uuid NOT IN (SELECT source_uuid FROM rel WHERE confidence > 0.15) AND uuid NOT IN (SELECT target_uuid FROM rel WHERE confidence > 0.15)")
def orphan_entities(spark, sf):
    s = fx.state(spark, sf)
    return graph.orphans(s.with_(relations=s.relations.where("confidence > 0.15"))).select("uuid", "name")


# ---- writes ----

OUTCOMES = """hashed AS (SELECT seq, uuid, sha256(content) AS h, tags, content FROM batch),
firsts AS (SELECT h, min(seq) AS seq, arg_min(uuid, seq) AS uuid FROM hashed GROUP BY h),
live AS (SELECT content_hash AS h, arg_min(uuid, id) AS uuid FROM mem WHERE status <> 'deleted' GROUP BY 1),
outcome AS (SELECT b.seq, coalesce(live.uuid, f.uuid) AS uuid, CASE WHEN live.uuid IS NULL AND b.seq = f.seq THEN 'inserted' ELSE 'duplicate' END AS action, b.tags, b.content FROM hashed b JOIN firsts f USING (h) LEFT JOIN live USING (h))"""


@query("SELECT seq, uuid, action FROM outcome", OUTCOMES)
def dedup_insert(spark, sf):
    return writes.dedup_outcomes(fx.state(spark, sf), fx.batch(spark, sf)).select("seq", "uuid", "action")


@query("""SELECT seq, uuid, action = 'duplicate' AS duplicate, action = 'inserted' AS embedding_stored FROM outcome""", OUTCOMES.replace("sha256(content)", r"sha256(regexp_replace(content, '^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$', '', 'g'))"))
def remember_batch(spark, sf):
    _, out = writes.remember(fx.state(spark, sf), fx.batch(spark, sf), NOW, vectors.mock_embedding, 64)
    return out.select("seq", "uuid", "duplicate", "embedding_stored")


@query()
def remember_batch_state(spark, sf):
    """Of each table of the new state: its rows, and the sum of their hashes."""
    new, _ = writes.remember(fx.passing_state(spark, sf), fx.batch(spark, sf), NOW, vectors.mock_embedding, 64)
    out = None
    for name in ("memory", "memory_tags", "embeddings", "entities", "relations"):
        rows = getattr(new, name)
        digest = rows.select(F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("h")).agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.sum("h").cast("string").alias("digest"))
        out = digest if out is None else out.unionByName(digest)
    return out


FRESH = OUTCOMES.replace("sha256(content)", r"sha256(regexp_replace(content, '^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$', '', 'g'))")


@query("SELECT uuid, content_hash, status FROM mem UNION ALL SELECT uuid, h, 'active' FROM outcome JOIN hashed USING (seq, uuid) WHERE action = 'inserted'", FRESH)
def remember_memory(spark, sf):
    """The memory table after a batch, with extraction and embedding on."""
    new, _ = writes.remember(fx.state(spark, sf), fx.batch(spark, sf), NOW, vectors.mock_embedding, 64)
    return new.memory.select("uuid", "content_hash", "status")


@query("SELECT memory_uuid, tag FROM mtags UNION SELECT uuid, unnest(tags) FROM outcome", FRESH)
def remember_tags(spark, sf):
    new, _ = writes.remember(fx.state(spark, sf), fx.batch(spark, sf), NOW, None, 64, extract_graph=False)
    return new.memory_tags.select("memory_uuid", "tag")


@query("SELECT uuid, importance, metadata_json FROM (SELECT uuid, CASE WHEN uuid = md5('m:7') THEN 0.9::DOUBLE ELSE importance END AS importance, CASE WHEN uuid = md5('m:7') THEN '{\"k\": \"v\"}' ELSE metadata_json END AS metadata_json FROM mem)")
def update_memory(spark, sf):
    new = forget.update(fx.state(spark, sf), _md5("m:7"), importance=0.9, metadata_json='{"k": "v"}')
    return new.memory.select("uuid", "importance", "metadata_json")


@query("SELECT uuid FROM mem WHERE status <> 'deleted' AND id % 3 = 1")
def filter_metadata(spark, sf):
    s = fx.state(spark, sf)
    s = s.with_(memory=s.memory.withColumn("metadata_json", F.to_json(F.struct((F.col("id") % 3).cast("string").alias("a.b's"), F.col("id").alias("n")))))
    return for_listing(s, MemoryFilter(metadata_match={"a.b's": "1"})).select("uuid")


@query("SELECT 'entity' AS kind, uuid FROM ent WHERE type <> 'nation' UNION ALL SELECT 'relation', uuid FROM rel WHERE source_uuid NOT IN (SELECT uuid FROM ent WHERE type = 'nation') AND target_uuid NOT IN (SELECT uuid FROM ent WHERE type = 'nation')")
def entity_delete(spark, sf):
    s = fx.state(spark, sf)
    new = forget.delete_entities(s, s.entities.where("type = 'nation'").select("uuid"))
    return new.entities.select(F.lit("entity").alias("kind"), "uuid").unionByName(new.relations.select(F.lit("relation").alias("kind"), "uuid"))


@query("SELECT uuid, predicate FROM rel WHERE predicate <> 'located_in'")
def relation_delete(spark, sf):
    s = fx.state(spark, sf)
    return forget.delete_relations(s, s.relations.where("predicate = 'located_in'").select("uuid")).relations.select("uuid", "predicate")


@query("SELECT memory_uuid, round(vector[1], 6) AS first FROM emb JOIN mem ON uuid = memory_uuid WHERE status <> 'archived'")
def vector_delete(spark, sf):
    s = fx.state(spark, sf)
    return forget.delete_vectors(s, s.memory.where("status = 'archived'")).embeddings.select("memory_uuid", r6(F.get("vector", F.lit(0))).alias("first"))


@query("""SELECT uuid, (CASE WHEN n >= 9223372036854775808 THEN n - 18446744073709551616 ELSE n END)::BIGINT AS rowid FROM (
  SELECT uuid, list_sum([(instr('0123456789abcdef', uuid[2 * i + 1]) * 16 - 16 + instr('0123456789abcdef', uuid[2 * i + 2]) - 1)::HUGEINT * (256::HUGEINT ** i)::HUGEINT FOR i IN range(8)])::HUGEINT AS n FROM mem)""")
def uuid_rowid(spark, sf):
    return fx.memory(spark, sf).select("uuid", vectors.uuid_rowid(F.col("uuid")).alias("rowid"))


@query(f"SELECT uuid, (created_at - {EPOCH}) / 60.0::DOUBLE AS minutes, last_accessed IS NULL AS unseen, 'OBJECT<>' AS metadata FROM mem")
def memory_typed(spark, sf):
    rows = catalog.typed(fx.state(spark, sf).memory)
    minutes = (F.col("created_at").cast("double") - EPOCH) / 60.0
    return rows.select("uuid", minutes.alias("minutes"), F.col("last_accessed").isNull().alias("unseen"), F.schema_of_variant("metadata").alias("metadata"))


@query("""SELECT least::DOUBLE AS min_confidence, (SELECT count(*) FROM (SELECT DISTINCT name, type FROM pe)) AS entities, CASE WHEN least <= 0.3 THEN (SELECT count(*) FROM (SELECT DISTINCT a.eid, b.eid AS e2 FROM pairs JOIN (SELECT uuid, name, md5('e:' || type || ':' || name) AS eid FROM pe) a ON a.uuid = pairs.uuid AND a.name = source_name JOIN (SELECT uuid, name, md5('e:' || type || ':' || name) AS eid FROM pe) b ON b.uuid = pairs.uuid AND b.name = target_name)) ELSE 0 END AS relations FROM (SELECT unnest([0.0, 0.3, 0.31]) AS least)""", MENTIONS)
def link_min_confidence(spark, sf):
    s, out = fx.bare_state(spark), None
    for least in (0.0, 0.3, 0.31):
        _, entities, relations = writes.link(s, fx.part_texts(spark, sf), NOW, min_confidence=least)
        one = entities.agg(F.count("*").alias("entities")).crossJoin(relations.agg(F.count("*").alias("relations"))).select(F.lit(least).alias("min_confidence"), "entities", "relations")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT memory_uuid, array_to_string(list_sort(list(tag)), ',') AS tags FROM (SELECT memory_uuid, tag FROM mtags UNION SELECT uuid, unnest(['kept', source]) FROM mem) GROUP BY 1")
def tag_attach(spark, sf):
    m = fx.memory(spark, sf)
    rows = m.select(F.col("uuid").alias("memory_uuid"), F.array(F.lit(" kept "), F.col("source"), F.lit("  ")).alias("tags"))
    return _tags(writes.attach_tags(fx.state(spark, sf), rows))


@query("SELECT memory_uuid, array_to_string(list_sort(list(tag)), ',') AS tags FROM mtags WHERE tag NOT IN ('en', 'toxic') GROUP BY 1")
def tag_detach(spark, sf):
    rows = fx.memory(spark, sf).select(F.col("uuid").alias("memory_uuid"), F.array(F.lit("en"), F.lit("toxic ")).alias("tags"))
    return _tags(writes.detach_tags(fx.state(spark, sf), rows))


@query("SELECT memory_uuid, array_to_string(list_sort(list(tag)), ',') AS tags FROM (SELECT memory_uuid, tag FROM mtags JOIN mem ON uuid = memory_uuid WHERE source <> 'user' UNION SELECT uuid, unnest(['a', 'b']) FROM mem WHERE source = 'user') GROUP BY 1")
def tag_replace(spark, sf):
    rows = fx.memory(spark, sf).where("source = 'user'").select(F.col("uuid").alias("memory_uuid"), F.array(F.lit("b"), F.lit(" a "), F.lit("b")).alias("tags"))
    return _tags(writes.replace_tags(fx.state(spark, sf), rows))


def _tags(state):
    return state.tags_by_memory().select("memory_uuid", F.array_join("tags", ",").alias("tags"))


@query("SELECT memory_uuid, model, round(vector[1], 6) AS first FROM (SELECT memory_uuid, 'given' AS model, vector FROM emb WHERE memory_uuid NOT IN (SELECT md5('m:' || label) FROM embeddings) UNION ALL SELECT md5('m:' || label), 'new', arg_max(embedding, vec_id)::DOUBLE[] FROM embeddings GROUP BY label)")
def vector_upsert(spark, sf):
    rows = fx.table(spark, sf, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("seq"), fx._uuid("m", F.col("label").cast("string")).alias("memory_uuid"), F.col("embedding").alias("vector"))
    new = writes.upsert_vectors(fx.state(spark, sf), rows, 64, "test", "new", NOW)
    return new.embeddings.select("memory_uuid", "model", r6(F.get("vector", F.lit(0))).alias("first"))


@query("""SELECT name, type, min(uuid) AS uuid, CASE WHEN min(src) = 0 THEN 'updated' ELSE 'created' END AS action FROM (
  SELECT uuid, name, type, 0 AS src FROM ent WHERE type IN ('nation', 'region') UNION ALL SELECT NULL, name, type, 0 FROM ent WHERE false UNION ALL
  SELECT CASE WHEN n_name IN (SELECT name FROM ent WHERE type = 'nation') THEN NULL END, n_name, 'nation', 1 FROM nation UNION ALL SELECT md5('new:' || n_nationkey), 'New ' || n_name, 'nation', 1 FROM nation)
GROUP BY name, type HAVING max(src) = 1""")
def entity_upsert(spark, sf):
    n = fx.table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("long")
    none = F.lit(None).cast("string")
    rows = n.select(key.alias("seq"), fx._uuid("new", key.cast("string")).alias("uuid"), F.concat(F.lit(" "), F.col("n_name")).alias("name"), F.lit("nation").alias("type"), F.lit("again").alias("description"), none.alias("metadata_json"))
    rows = rows.unionByName(rows.withColumn("name", F.concat(F.lit("New"), F.col("name"))))
    s = fx.state(spark, sf)
    s = s.with_(entities=s.entities.where(F.col("type").isin("nation", "region")))
    return writes.upsert_entities(s, rows, NOW)[1].select("name", "type", "uuid", "action")


@query("""SELECT source_uuid, predicate, target_uuid, CASE WHEN old IS NULL THEN 'inserted' WHEN new > old THEN 'updated' ELSE 'unchanged' END AS action, round(CASE WHEN old IS NULL OR new > old THEN new ELSE old END, 6) AS confidence
FROM (SELECT n.*, rel.confidence AS old FROM (SELECT md5('part:' || l_partkey) AS source_uuid, 'supplied_by' AS predicate, md5('supplier:' || l_suppkey) AS target_uuid, max(l_tax * 5) AS new FROM lineitem GROUP BY ALL
UNION ALL SELECT md5('customer:' || c_custkey), 'served_by', md5('nation:' || c_nationkey), 0.5::DOUBLE FROM customer) n LEFT JOIN rel USING (source_uuid, predicate, target_uuid))""")
def relation_upsert(spark, sf):
    li, c = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "customer")

    def rows(df, seq, a, b, predicate, confidence):
        return df.select(seq.alias("seq"), F.lit(None).cast("string").alias("memory_uuid"), a.alias("source_uuid"), b.alias("target_uuid"), F.lit(predicate).alias("predicate"), confidence.alias("confidence"), F.lit("{}").alias("metadata_json"))

    new = rows(li, F.col("l_orderkey") * 10 + F.col("l_linenumber"), fx._uuid("part", F.col("l_partkey").cast("string")), fx._uuid("supplier", F.col("l_suppkey").cast("string")), "supplied_by", F.col("l_tax") * 5)
    new = new.unionByName(rows(c, F.col("c_custkey"), fx._uuid("customer", F.col("c_custkey").cast("string")), fx._uuid("nation", F.col("c_nationkey").cast("string")), "served_by", F.lit(0.5)))
    new = new.withColumn("uuid", fx._uuid("r", "source_uuid", "predicate", "target_uuid"))
    _, out = writes.upsert_relations(fx.state(spark, sf), new, NOW)
    return out.select("source_uuid", "predicate", "target_uuid", "action", r6("confidence").alias("confidence"))


@query("SELECT 'entity' AS kind, count(*) AS n FROM (SELECT DISTINCT name, type FROM pe) UNION ALL SELECT 'relation', count(*) FROM (SELECT DISTINCT a.eid, b.eid AS e2 FROM pairs JOIN (SELECT uuid, name, md5('e:' || type || ':' || name) AS eid FROM pe) a ON a.uuid = pairs.uuid AND a.name = source_name JOIN (SELECT uuid, name, md5('e:' || type || ':' || name) AS eid FROM pe) b ON b.uuid = pairs.uuid AND b.name = target_name)", MENTIONS)
def extract_link(spark, sf):
    _, entities, relations = writes.link(fx.bare_state(spark), fx.part_texts(spark, sf), NOW)
    return entities.agg(F.count("*").alias("n")).select(F.lit("entity").alias("kind"), "n").unionByName(relations.agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "n"))


@query("SELECT DISTINCT 'entity' AS kind, md5('e:' || type || ':' || name) AS uuid, type AS label FROM pe", MENTIONS)
def extract_link_entities(spark, sf):
    new, _, _ = writes.link(fx.bare_state(spark), fx.part_texts(spark, sf), NOW)
    return new.entities.select(F.lit("entity").alias("kind"), "uuid", F.col("type").alias("label"))


@query("""SELECT DISTINCT a.eid AS source_uuid, b.eid AS target_uuid, 'mentions' AS predicate, 0.3::DOUBLE AS confidence FROM pairs JOIN (SELECT uuid, name, md5('e:' || type || ':' || name) AS eid FROM pe) a ON a.uuid = pairs.uuid AND a.name = source_name
JOIN (SELECT uuid, name, md5('e:' || type || ':' || name) AS eid FROM pe) b ON b.uuid = pairs.uuid AND b.name = target_name""", MENTIONS)
def extract_link_relations(spark, sf):
    new, _, _ = writes.link(fx.bare_state(spark), fx.part_texts(spark, sf), NOW)
    return new.relations.select("source_uuid", "target_uuid", "predicate", "confidence")


@query(f"SELECT uuid, access_count + CASE WHEN uuid IN (SELECT uuid FROM sem) THEN 1 ELSE 0 END AS access_count, CASE WHEN uuid IN (SELECT uuid FROM sem) THEN {NOW} ELSE last_accessed END AS last_accessed FROM mem", SEMANTIC)
def mark_accessed(spark, sf):
    new = recall.apply_feedback(fx.state(spark, sf), _seeds(spark, sf), NOW)
    return new.memory.select("uuid", "access_count", "last_accessed")


GONE = "gone AS (SELECT uuid FROM mem WHERE status <> 'deleted' AND importance <= 0.5::DOUBLE ORDER BY created_at DESC, id LIMIT 300)"


def _gone(spark, sf):
    return forget.targets(fx.state(spark, sf), MemoryFilter(importance_max=0.5), 300)


@query("SELECT uuid, CASE WHEN uuid IN (SELECT uuid FROM gone) THEN 'deleted' ELSE status END AS status FROM mem", GONE)
def forget_soft_filter(spark, sf):
    return forget.forget(fx.state(spark, sf), _gone(spark, sf), "soft").memory.select("uuid", "status")


@query("""SELECT (SELECT count(*) FROM mem WHERE uuid NOT IN (SELECT uuid FROM gone)) AS memories, (SELECT count(*) FROM emb WHERE memory_uuid NOT IN (SELECT uuid FROM gone)) AS vectors,
(SELECT count(*) FROM mtags WHERE memory_uuid NOT IN (SELECT uuid FROM gone)) AS tags, (SELECT count(*) FROM rel WHERE memory_uuid IS NOT NULL AND memory_uuid NOT IN (SELECT uuid FROM gone)) AS linked, (SELECT count(*) FROM rel) AS relations""", GONE)
def forget_hard_cascade(spark, sf):
    new = forget.forget(fx.state(spark, sf), _gone(spark, sf), "hard")
    out = new.memory.agg(F.count("*").alias("memories")).crossJoin(new.embeddings.agg(F.count("*").alias("vectors"))).crossJoin(new.memory_tags.agg(F.count("*").alias("tags")))
    return out.crossJoin(new.relations.agg(F.count("memory_uuid").alias("linked"), F.count("*").alias("relations")))


@query(f"SELECT uuid, CASE WHEN status = 'active' AND expires_at < {NOW} THEN 'expired' ELSE status END AS status FROM mem")
def ttl_expire(spark, sf):
    return forget.expire(fx.state(spark, sf), NOW).memory.select("uuid", "status")


@query(f"SELECT uuid, CASE WHEN uuid IN (SELECT uuid FROM mem WHERE status = 'active' AND coalesce(last_accessed, created_at) < {NOW} - 432000 AND importance <= 0.5::DOUBLE ORDER BY created_at DESC, id LIMIT 1000) THEN 'archived' ELSE status END AS status FROM mem")
def gc_stale(spark, sf):
    return forget.collect_stale(fx.state(spark, sf), NOW, stale_after=5 * DAY, importance_at_most=0.5).memory.select("uuid", "status")
