"""The driver's tables as a state of the engine, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import retrieval
from ..operators.cut import shared_folder
from ..schema import SOURCES, struct
from ..state import MemoryState

EPOCH, HOUR, DAY, NOW = 1704067200, 3600, 86400, 1706659200  # 2024-01-01 and 2024-01-31


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _uuid(kind: str, *parts):
    return F.md5(F.concat_ws(":", F.lit(kind), *parts))


_STORED: dict[tuple, str] = {}


def _stored(build):
    """The table is made once for each session and input, in the shared folder, and read from there: the
    queries run on stored tables as an engine's do."""

    def read(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _STORED:
            path = f"{shared_folder(spark)}/{build.__name__}-{uuid.uuid4().hex}"
            build(spark, sf).write.parquet(path)
            _STORED[key] = path
        return spark.read.parquet(_STORED[key])

    read.plan = build
    return read


@_stored
def memory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as memories, with tags."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    seen = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max(F.unix_timestamp("ts")).alias("la"))
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), "lang", F.col("source").alias("origin"))
    d = d.withColumn("content_hash", content_hash(F.col("content")))  # before the joins, which then move no text for readers of the hash only
    rows = d.join(labels, "doc_id", "left").join(seen, "doc_id", "left")
    i, created = F.col("doc_id"), F.lit(EPOCH) + F.lit(HOUR) * F.col("doc_id")
    status = F.when(i % 10 == 7, "archived").when(i % 10 == 8, "deleted").when(i % 10 == 9, "expired").otherwise("active")
    tags = F.array_sort(F.array_distinct(F.filter(F.array("lang", "origin", F.when(F.col("toxic") == 1, "toxic")), lambda t: t.isNotNull())))
    return rows.select(
        i.alias("id"), _uuid("m", i.cast("string")).alias("uuid"), "content", "content_hash", F.lit("{}").alias("metadata_json"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (i % 4 + 1).cast("int")).alias("source"), F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.2).otherwise(0.5).alias("importance"),
        F.coalesce("n", F.lit(0)).alias("access_count"), F.col("la").alias("last_accessed"), created.alias("created_at"), F.when(i % 5 == 0, created + F.lit(DAY) * (i % 30)).alias("expires_at"), status.alias("status"), tags.alias("tags"),
    )


@_stored
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sorted_index(retrieval.keyword_index(memory(spark, sf)))


@_stored
def entities(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, key, label in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        k = F.col(key).cast("long")
        kind = F.when(k % 7 == 0, "unknown").otherwise(name) if name == "part" else F.lit(name)
        rows = table(spark, sf, name).select(_uuid(name, k.cast("string")).alias("uuid"), F.col(label).alias("name"), kind.alias("type"), F.lit(None).cast("string").alias("description"), F.lit("{}").alias("metadata_json"), F.lit(EPOCH).cast("long").alias("created_at"), (F.lit(EPOCH) + 60 * k).alias("updated_at"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_stored
def relations(spark: SparkSession, sf: str) -> DataFrame:
    def edge(rows, a, key_a, b, key_b, predicate, confidence, memory=F.lit(None).cast("string")):
        ends = [_uuid(a, F.col(key_a).cast("long").cast("string")), _uuid(b, F.col(key_b).cast("long").cast("string"))]
        rows = rows.select(ends[0].alias("source_uuid"), ends[1].alias("target_uuid"), F.lit(predicate).alias("predicate"), confidence.alias("confidence"), memory.alias("memory_uuid"))
        return rows.select(_uuid("r", "source_uuid", "predicate", "target_uuid").alias("uuid"), "*", F.lit("{}").alias("metadata_json"), F.lit(EPOCH).cast("long").alias("created_at"))

    # dealt by part once: both the groups and the join with documents are within that
    supplied = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    supplied = supplied.join(table(spark, sf, "documents").select("doc_id"), F.col("doc_id") == F.col("l_partkey"), "left")
    out = edge(table(spark, sf, "nation"), "nation", "n_nationkey", "region", "n_regionkey", "in_region", F.lit(1.0))
    out = out.unionByName(edge(table(spark, sf, "customer"), "customer", "c_custkey", "nation", "c_nationkey", "located_in", F.lit(0.9)))
    out = out.unionByName(edge(table(spark, sf, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "located_in", F.lit(0.9)))
    return out.unionByName(edge(supplied, "part", "l_partkey", "supplier", "l_suppkey", "supplied_by", F.least(F.lit(1.0), F.col("n") / 10.0), F.when(F.col("doc_id").isNotNull(), _uuid("m", F.col("doc_id").cast("string")))))


@_stored
def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    return e.select(_uuid("m", F.col("vec_id").cast("string")).alias("memory_uuid"), F.size("embedding").alias("dims"), F.lit("given").alias("provider"), F.lit("given").alias("model"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(EPOCH).cast("long").alias("created_at"))


def state(spark: SparkSession, sf: str) -> MemoryState:
    rows = memory(spark, sf)
    tags = rows.select(F.col("uuid").alias("memory_uuid"), F.explode("tags").alias("tag"))
    return MemoryState(rows.drop("tags"), embeddings(spark, sf), entities(spark, sf), relations(spark, sf), tags, postings(spark, sf))


def passing_state(spark: SparkSession, sf: str) -> MemoryState:
    """state() for a query that reads texts and the graph once and no keyword index: none is stored for it."""
    rows = memory.plan(spark, sf)
    tags = rows.select(F.col("uuid").alias("memory_uuid"), F.explode("tags").alias("tag"))
    return MemoryState(rows.drop("tags"), embeddings(spark, sf), entities.plan(spark, sf), relations.plan(spark, sf), tags)


def bare_state(spark: SparkSession) -> MemoryState:
    """Without a row: for what reads texts only, so that no table is made for it."""
    return MemoryState(*(spark.createDataFrame([], struct(t)) for t in ("memory", "embeddings", "entities", "relations", "memory_tags")))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """One row's vector, as a query's input."""
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def part_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(uuid, content): parts described with links and tags."""
    content = F.concat(F.lit("[["), F.col("p_brand"), F.lit("|brand]] "), F.col("p_name"), F.lit(" #"), F.lower("p_type"), F.lit(" for [["), F.col("p_type"), F.lit("]] by Acme Corp"))
    return table(spark, sf, "part").select(_uuid("t", F.col("p_partkey").cast("string")).alias("uuid"), content.alias("content"))


def batch(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, uuid, content, source, importance, tags): conversations, then all documents once more."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("a"), F.col("turn").cast("long").alias("b"), "role", F.coalesce("text", F.lit("")).alias("content"))
    source = F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "system", "system").otherwise("user")
    c = c.select((F.col("a") * 1000 + F.col("b")).alias("seq"), _uuid("c", F.col("a").cast("string"), F.col("b").cast("string")).alias("uuid"), "content", source.alias("source"), F.lit(0.5).alias("importance"), F.array(F.lit(" chat "), F.col("role")).alias("tags"))
    d = table(spark, sf, "documents").select((F.lit(10**12) + F.col("doc_id")).alias("seq"), _uuid("d", F.col("doc_id").cast("string")).alias("uuid"), F.coalesce("text", F.lit("")).alias("content"), F.lit("user").alias("source"), F.lit(0.5).alias("importance"), F.array(F.lit("again")).alias("tags"))
    return c.unionByName(d).where("content <> ''")


SQL = f"""
ev AS (SELECT user_id, count(*) AS n, max(floor(epoch(ts)))::BIGINT AS la FROM events GROUP BY user_id),
mem AS (SELECT d.doc_id AS id, md5('m:' || d.doc_id) AS uuid, coalesce(d.text, '') AS content, sha256(coalesce(d.text, '')) AS content_hash, '{{}}' AS metadata_json,
  ['agent', 'user', 'system', 'tool'][d.doc_id % 4 + 1] AS source, CASE l.quality WHEN 1 THEN 0.8::DOUBLE WHEN 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS importance,
  coalesce(ev.n, 0) AS access_count, ev.la AS last_accessed, {EPOCH} + {HOUR} * d.doc_id AS created_at,
  CASE WHEN d.doc_id % 5 = 0 THEN {EPOCH} + {HOUR} * d.doc_id + {DAY} * (d.doc_id % 30) END AS expires_at,
  CASE d.doc_id % 10 WHEN 7 THEN 'archived' WHEN 8 THEN 'deleted' WHEN 9 THEN 'expired' ELSE 'active' END AS status,
  list_sort(list_distinct(list_filter([d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL))) AS tags
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN ev ON ev.user_id = d.doc_id),
mtags AS (SELECT uuid AS memory_uuid, unnest(tags) AS tag FROM mem),
emb AS (SELECT md5('m:' || vec_id) AS memory_uuid, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
ent AS (SELECT md5(k || ':' || i) AS uuid, name, CASE WHEN k = 'part' AND i % 7 = 0 THEN 'unknown' ELSE k END AS type, {EPOCH} + 60 * i AS updated_at FROM (
  SELECT 'region' AS k, r_regionkey::BIGINT AS i, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey::BIGINT, n_name FROM nation
  UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part)),
edges0 AS (SELECT md5('nation:' || n_nationkey) AS source_uuid, md5('region:' || n_regionkey) AS target_uuid, 'in_region' AS predicate, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS memory_uuid FROM nation
  UNION ALL SELECT md5('customer:' || c_custkey), md5('nation:' || c_nationkey), 'located_in', 0.9::DOUBLE, NULL FROM customer
  UNION ALL SELECT md5('supplier:' || s_suppkey), md5('nation:' || s_nationkey), 'located_in', 0.9::DOUBLE, NULL FROM supplier
  UNION ALL SELECT md5('part:' || l_partkey), md5('supplier:' || l_suppkey), 'supplied_by', least(1.0::DOUBLE, n / 10.0::DOUBLE), CASE WHEN doc_id IS NOT NULL THEN md5('m:' || doc_id) END
    FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) LEFT JOIN documents ON doc_id = l_partkey),
rel AS (SELECT md5('r:' || source_uuid || ':' || predicate || ':' || target_uuid) AS uuid, * FROM edges0),
adj AS (SELECT source_uuid AS u, target_uuid AS v, 0 AS dir, uuid AS edge FROM rel UNION ALL SELECT target_uuid, source_uuid, 1, uuid FROM rel),
ptext AS (SELECT md5('t:' || p_partkey) AS uuid, '[[' || p_brand || '|brand]] ' || p_name || ' #' || lower(p_type) || ' for [[' || p_type || ']] by Acme Corp' AS content, p_brand, p_type FROM part),
batch AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS seq, md5('c:' || conv_id || ':' || turn) AS uuid, coalesce(text, '') AS content, ['chat', role] AS tags FROM conversations
  UNION ALL SELECT 1000000000000 + doc_id, md5('d:' || doc_id), coalesce(text, ''), ['again'] FROM documents) WHERE content <> '')"""
