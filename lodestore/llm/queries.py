"""The queries of this subpackage: each applies one operator, with its production parameters, to
its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: The key of the query's pseudonyms; the tables are made up. Users of the operator pass their own.
PII_KEY = b"key of the registered query"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_store, write_store

    folder, keys = write_store(_documents(spark, sf_dir), end_id=2)
    return read_store(spark, folder, keys).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    return near_dedup(_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_dedup

    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import redact

    return redact(_documents(spark, sf_dir), key=PII_KEY)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_documents(spark, sf_dir), 24)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), size=2048, end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_ids, op2_simhash, op3_quality, op4_embedding_dedup, op5_exact_dedup, op6_pii, op7_sharding, op8_mixing, op9_toxicity, op10_packing)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS i FROM s0),
s2 AS (SELECT *, [5, 2, 1][i % 3 + 1]::DOUBLE AS w FROM s1),
s3 AS (SELECT *, (1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS each
  FROM s2 WINDOW before AS (ORDER BY 2 * size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT each FROM s3 WHERE each * w <= 2 * size ORDER BY 2 * size / w, i LIMIT 1),
s4 AS (SELECT source, s3.size, n, i, least(2.0 * s3.size, level.each * w) AS target FROM s3, level),
b AS (SELECT greatest(1, floor(min(target) FILTER (target > 0) / 1000 + 1e-9))::BIGINT AS block, sum(target) AS goals, max(n) AS most FROM s4),
seats AS (SELECT block, round(goals / block)::BIGINT AS seats, greatest(1, ceil(most / greatest(2000, floor(sqrt(most)))))::BIGINT AS blocks FROM b),
quotients AS (SELECT i, target / (2 * q + 1) AS quotient FROM (SELECT i, target, unnest(range(0, (target / block)::BIGINT + 3)) AS q FROM s4, seats WHERE target > 0)),
dealt AS (SELECT i, r, row_number() OVER (PARTITION BY i ORDER BY r) - 1 AS j, (24 * r + seats - 1) // seats - 1 AS shard
  FROM (SELECT i, row_number() OVER (ORDER BY quotient DESC, i) AS r FROM quotients), seats WHERE r <= seats),
quota AS (SELECT i, count(*) AS quota FROM dealt GROUP BY i),
s5 AS (SELECT s4.*, least(coalesce(quota, 0) * block, 2 * size)::BIGINT AS words, blocks FROM s4 LEFT JOIN quota USING (i), seats),
x AS (SELECT d.doc_id, d.size, i, s5.size AS source_size, target, words, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substring(ord, 1, 8))::BIGINT % blocks, ord, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
y AS (SELECT *, words // greatest(source_size, 1) AS passes, greatest(0, least(size, words % greatest(source_size, 1) - before)) AS part FROM x),
z AS (SELECT y.*, passes * size + part AS taken, CASE WHEN part > 0 THEN passes * source_size + before + part ELSE (passes - 1) * source_size + before + size END - 1 AS final FROM y)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN a.shard END::INTEGER AS first_shard, CASE WHEN taken > 0 THEN b.shard END::INTEGER AS last_shard
FROM z CROSS JOIN seats LEFT JOIN dealt a ON a.i = z.i AND a.j = z.before // block LEFT JOIN dealt b ON b.i = z.i AND b.j = z.final // block""",
}
