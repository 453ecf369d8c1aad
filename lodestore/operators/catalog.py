"""Point look-ups, listings, counts and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..state import MemoryState
from .filters import MemoryFilter, for_listing

LIST_CAP = 10_000


def _page(rows: DataFrame, order: list, limit: int, offset: int = 0, cap: int = LIST_CAP) -> DataFrame:
    if limit < 0 or offset < 0:
        raise ValidationError("limit and offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(min(limit, cap)) if offset else rows.orderBy(*order).limit(min(limit, cap))


def get_memory(state: MemoryState, uuid: str) -> DataFrame:
    """Of any status; no row if there is none."""
    return state.with_tags(state.memory.where(F.col("uuid") == uuid))


def list_memories(state: MemoryState, f: MemoryFilter = MemoryFilter(), limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; equal times by id."""
    return state.with_tags(_page(for_listing(state, f), [F.desc("created_at"), "id"], limit, offset))


def count_memories(state: MemoryState, f: MemoryFilter = MemoryFilter()) -> DataFrame:
    return for_listing(state, f).agg(F.count("*").alias("n"))


def entity(state: MemoryState, uuid: str | None = None, name: str | None = None, kind: str | None = None) -> DataFrame:
    if uuid is not None:
        return state.entities.where(F.col("uuid") == uuid)
    return state.entities.where((F.col("name") == name) & (F.col("type") == kind)).limit(1)


def list_entities(state: MemoryState, name_prefix: str | None = None, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Latest update first. The prefix ignores case."""
    rows = state.entities
    if name_prefix:
        rows = rows.where(F.lower("name").startswith(name_prefix.lower()))
    if kind:
        rows = rows.where(F.col("type") == kind)
    return _page(rows, [F.desc("updated_at"), "uuid"], limit, offset)


def relation(state: MemoryState, uuid: str) -> DataFrame:
    return state.relations.where(F.col("uuid") == uuid)


def _edges(state: MemoryState, column: str, uuid: str, predicate: str | None, limit: int) -> DataFrame:
    rows = state.relations.where(F.col(column) == uuid)
    if predicate:
        rows = rows.where(F.col("predicate") == predicate)
    return _page(rows, [F.desc("confidence"), "uuid"], limit)


def list_outgoing(state: MemoryState, uuid: str, predicate: str | None = None, limit: int = 100) -> DataFrame:
    return _edges(state, "source_uuid", uuid, predicate, limit)


def list_incoming(state: MemoryState, uuid: str, predicate: str | None = None, limit: int = 100) -> DataFrame:
    return _edges(state, "target_uuid", uuid, predicate, limit)


def list_relations(state: MemoryState, source: str | None = None, target: str | None = None, limit: int = 100, offset: int = 0, latest_entities: int = 50) -> DataFrame:
    """Of a source, of a target, of both (the target condition comes after the limit), or of the
    latest entities; highest uuid first in that last case."""
    if source:
        rows = list_outgoing(state, source, None, min(limit, 500))
        return rows.where(F.col("target_uuid") == target) if target else rows
    if target:
        return list_incoming(state, target, None, min(limit, 500))
    latest = list_entities(state, limit=latest_entities).select(F.col("uuid").alias("source_uuid"))
    rows = state.relations.join(F.broadcast(latest), "source_uuid", "left_semi")  # at most latest_entities rows
    return _page(rows, [F.desc("uuid")], limit, offset, 500)


TIMES = ("created_at", "updated_at", "last_accessed", "expires_at")


def typed(rows: DataFrame) -> DataFrame:
    """Rows of any table for use outside of the engine: epoch seconds as timestamps, and metadata (a
    variant; null where metadata_json is no JSON) in place of metadata_json."""
    for name in set(TIMES) & set(rows.columns):
        rows = rows.withColumn(name, F.timestamp_seconds(name))
    return rows.withColumn("metadata", F.try_parse_json("metadata_json")).drop("metadata_json") if "metadata_json" in rows.columns else rows


def tag_counts(state: MemoryState, limit: int = LIST_CAP, offset: int = 0) -> DataFrame:
    counts = state.memory_tags.groupBy("tag").agg(F.countDistinct("memory_uuid").alias("memory_count"))
    return _page(counts, [F.desc("memory_count"), "tag"], limit, offset)


def tags_of_memory(state: MemoryState, uuid: str) -> DataFrame:
    return state.memory_tags.where(F.col("memory_uuid") == uuid).select("tag").distinct().orderBy("tag")


def stats(state: MemoryState) -> DataFrame:
    """One row; the total leaves out deleted rows."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    memory = state.memory.agg(n("active").alias("active"), n("archived").alias("archived"), F.count(F.when(F.col("status") != "deleted", 1)).alias("total"))
    for table, column in ((state.entities, "entities"), (state.relations, "relations"), (state.embeddings, "vectors")):
        memory = memory.crossJoin(table.agg(F.count("*").alias(column)))  # of one row each
    return memory.crossJoin(state.memory_tags.agg(F.countDistinct("tag").alias("tags")))
