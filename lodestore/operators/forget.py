"""Forgetting: soft, hard and archiving; orphans; expiry and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFoundError, ValidationError
from ..state import MemoryState
from . import graph
from .catalog import LIST_CAP
from .filters import MemoryFilter, for_listing

MODES = {"soft": "deleted", "archive": "archived", "hard": None}
GC_CAP = 1000


def targets(state: MemoryState, f: MemoryFilter, batch_limit: int = 500) -> DataFrame:
    """(uuid) of the newest rows that pass, at most batch_limit."""
    if batch_limit <= 0:
        raise ValidationError("batch_limit must be positive")
    return for_listing(state, f).orderBy(F.desc("created_at"), "id").limit(min(batch_limit, LIST_CAP)).select("uuid")


def set_status(state: MemoryState, uuids: DataFrame, status: str) -> MemoryState:
    hit = uuids.select("uuid").distinct().withColumn("_hit", F.lit(True))
    memory = state.memory.join(hit, "uuid", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status")))
    return state.with_(memory=memory.select(*state.memory.columns))


def delete(state: MemoryState, uuids: DataFrame) -> MemoryState:
    """Rows go, with their vectors and tags; relations lose the reference to them."""
    uuids = uuids.select("uuid").distinct()
    of_memory = uuids.withColumnRenamed("uuid", "memory_uuid")
    relations = state.relations.join(of_memory.withColumn("_gone", F.lit(True)), "memory_uuid", "left")
    relations = relations.withColumn("memory_uuid", F.when(F.col("_gone"), None).otherwise(F.col("memory_uuid"))).select(*state.relations.columns)
    if state.postings is not None:
        ids = state.memory.join(uuids, "uuid", "left_semi").select(F.col("id").alias("memory_id"))
        state = state.with_(postings=state.postings.join(ids, "memory_id", "left_anti").select(*state.postings.columns))
    return state.with_(memory=state.memory.join(uuids, "uuid", "left_anti"), embeddings=state.embeddings.join(of_memory, "memory_uuid", "left_anti"), memory_tags=state.memory_tags.join(of_memory, "memory_uuid", "left_anti"), relations=relations)


def forget(state: MemoryState, uuids: DataFrame, mode: str = "soft", gc_graph: bool = False) -> MemoryState:
    if mode not in MODES:
        raise ValidationError(f"unknown mode {mode!r}")
    state = delete(state, uuids) if mode == "hard" else set_status(state, uuids, MODES[mode])
    return collect_orphans(state) if gc_graph else state


def forget_one(state: MemoryState, uuid: str, mode: str = "soft", gc_graph: bool = False) -> MemoryState:
    one = state.memory.where(F.col("uuid") == uuid).select("uuid")
    if not one.limit(1).count():
        raise NotFoundError(f"no memory {uuid}")
    return forget(state, one, mode, gc_graph)


def collect_orphans(state: MemoryState) -> MemoryState:
    return delete_entities(state, graph.orphans(state).select("uuid"))


def delete_entities(state: MemoryState, uuids: DataFrame) -> MemoryState:
    """Their relations go too."""
    uuids = uuids.select("uuid").distinct()
    relations = state.relations
    for end in ("source_uuid", "target_uuid"):
        relations = relations.join(uuids.withColumnRenamed("uuid", end), end, "left_anti")
    return state.with_(entities=state.entities.join(uuids, "uuid", "left_anti"), relations=relations)


def delete_relations(state: MemoryState, uuids: DataFrame) -> MemoryState:
    return state.with_(relations=state.relations.join(uuids.select("uuid"), "uuid", "left_anti"))


def delete_vectors(state: MemoryState, uuids: DataFrame) -> MemoryState:
    """uuids of memories; those without a vector are no error."""
    gone = uuids.select(F.col("uuid").alias("memory_uuid"))
    return state.with_(embeddings=state.embeddings.join(gone, "memory_uuid", "left_anti").select(*state.embeddings.columns))


def _known(rows: DataFrame, uuid: str, what: str) -> DataFrame:
    one = rows.where(F.col("uuid") == uuid).select("uuid")
    if one.isEmpty():
        raise NotFoundError(f"no {what} {uuid}")
    return one


def delete_entity(state: MemoryState, uuid: str) -> MemoryState:
    return delete_entities(state, _known(state.entities, uuid, "entity"))


def delete_relation(state: MemoryState, uuid: str) -> MemoryState:
    return delete_relations(state, _known(state.relations, uuid, "relation"))


def update(state: MemoryState, uuid: str, importance: float | None = None, metadata_json: str | None = None) -> MemoryState:
    if importance is not None and not 0 <= importance <= 1:
        raise ValidationError("importance must be in [0, 1]")
    if not state.memory.where(F.col("uuid") == uuid).limit(1).count():
        raise NotFoundError(f"no memory {uuid}")
    memory, here = state.memory, F.col("uuid") == uuid
    for name, value in (("importance", importance), ("metadata_json", metadata_json)):
        if value is not None:
            memory = memory.withColumn(name, F.when(here, F.lit(value)).otherwise(F.col(name)))
    return state.with_(memory=memory)


def expire(state: MemoryState, now: int) -> MemoryState:
    """Active rows whose time is past become expired."""
    past = (F.col("status") == "active") & (F.col("expires_at") < now)
    return state.with_(memory=state.memory.withColumn("status", F.when(past, "expired").otherwise(F.col("status"))))


def stale(state: MemoryState, now: int, stale_after: int = 90 * 86400, importance_at_most: float = 0.3) -> DataFrame:
    """(uuid) of active rows not accessed for stale_after seconds and of low importance, inclusive."""
    f = MemoryFilter(status_in=["active"], last_accessed_before=now - stale_after, importance_max=importance_at_most)
    return targets(state, f, GC_CAP)


def collect_stale(state: MemoryState, now: int, action: str = "archive", enabled: bool = True, **policy) -> MemoryState:
    if not enabled:
        return state
    return forget(state, stale(state, now, **policy), "hard" if action == "delete" else "archive")
