"""Tables of the engine. Times are epoch seconds; scores are doubles."""

from __future__ import annotations

from pyspark.sql import types as T

STATUSES = ("active", "archived", "expired", "deleted")
SOURCES = ("agent", "user", "system", "tool")
SCHEMA_VERSION = 2


MEMORY = "id BIGINT, uuid STRING, content STRING, content_hash STRING, metadata_json STRING, source STRING, importance DOUBLE, access_count BIGINT, last_accessed BIGINT, created_at BIGINT, expires_at BIGINT, status STRING"
TABLES = {
    "memory": MEMORY,
    "entities": "uuid STRING, name STRING, type STRING, description STRING, metadata_json STRING, created_at BIGINT, updated_at BIGINT",
    "relations": "uuid STRING, source_uuid STRING, target_uuid STRING, predicate STRING, confidence DOUBLE, memory_uuid STRING, metadata_json STRING, created_at BIGINT",
    "memory_tags": "memory_uuid STRING, tag STRING",
    "embeddings": "memory_uuid STRING, dims INT, provider STRING, model STRING, vector ARRAY<DOUBLE>, created_at BIGINT",
    "postings": "term STRING, memory_id BIGINT, tf BIGINT, dl INT, positions ARRAY<INT>",
    "system_config": "key STRING, value_json STRING, updated_at BIGINT",
}


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
