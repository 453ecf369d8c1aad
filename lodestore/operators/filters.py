"""One filter for listing, counting, forgetting and recall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schema import SOURCES, STATUSES
from ..state import MemoryState


@dataclass(frozen=True)
class MemoryFilter:
    """All given conditions hold. Bounds of times and of access_count_lt are strict, those of
    importance inclusive. Staleness is the last access, or else the creation. metadata_match (JSON
    values by top-level key) is an extension."""

    status_in: list[str] | None = None
    source_in: list[str] | None = None
    created_after: int | None = None
    created_before: int | None = None
    importance_min: float | None = None
    importance_max: float | None = None
    access_count_lt: int | None = None
    last_accessed_before: int | None = None
    last_accessed_after: int | None = None
    tags_all: list[str] | None = None
    tags_any: list[str] | None = None
    metadata_match: dict[str, str] | None = None

    def check(self) -> None:
        if self.status_in is not None and not self.status_in:
            raise ValidationError("status_in must not be empty")
        for given, known in ((self.status_in, STATUSES), (self.source_in, SOURCES)):
            if unknown := set(given or ()) - set(known):
                raise ValidationError(f"unknown value {sorted(unknown)}")

    def columns(self) -> list[Column]:
        """Conditions on a memory row's own columns."""
        c, stale = F.col, F.coalesce("last_accessed", "created_at")
        out = []
        if self.source_in:
            out.append(c("source").isin(self.source_in))
        for value, column, op in (
            (self.created_after, c("created_at"), "__gt__"),
            (self.created_before, c("created_at"), "__lt__"),
            (self.importance_min, c("importance"), "__ge__"),
            (self.importance_max, c("importance"), "__le__"),
            (self.access_count_lt, c("access_count"), "__lt__"),
            (self.last_accessed_before, stale, "__lt__"),
            (self.last_accessed_after, stale, "__gt__"),
        ):
            if value is not None:
                out.append(getattr(column, op)(value))
        for k, v in (self.metadata_match or {}).items():
            out.append(F.try_element_at(F.from_json("metadata_json", "map<string,string>"), F.lit(k)) == v)
        return out


def _tagged(state: MemoryState, rows: DataFrame, f: MemoryFilter) -> DataFrame:
    """Tag conditions as semi-joins with the (memory, tag) pairs of the asked names only."""
    if f.tags_all:
        names = sorted(set(f.tags_all))
        pairs = state.memory_tags.where(F.col("tag").isin(names)).groupBy("memory_uuid").agg(F.countDistinct("tag").alias("n"))
        rows = rows.join(pairs.where(F.col("n") == len(names)), F.col("uuid") == F.col("memory_uuid"), "left_semi")
    if f.tags_any:
        pairs = state.memory_tags.where(F.col("tag").isin(sorted(set(f.tags_any))))
        rows = rows.join(pairs, F.col("uuid") == F.col("memory_uuid"), "left_semi")
    return rows


def for_listing(state: MemoryState, f: MemoryFilter = MemoryFilter(), rows: DataFrame | None = None) -> DataFrame:
    """Without status_in: all but deleted. Empty lists of sources and tags are no condition."""
    f.check()
    rows = state.memory if rows is None else rows
    rows = rows.where(F.col("status").isin(f.status_in) if f.status_in else F.col("status") != "deleted")
    for condition in f.columns():
        rows = rows.where(condition)
    return _tagged(state, rows, f)


def for_recall(state: MemoryState, rows: DataFrame, f: MemoryFilter = MemoryFilter(), status_scope: str = "active") -> DataFrame:
    """Candidates that pass. Without status_in: active ones, or all with status_scope='unfiltered'.
    Empty lists of sources or of tags_all match nothing."""
    f.check()
    if f.status_in:
        rows = rows.where(F.col("status").isin(f.status_in))
    elif status_scope != "unfiltered":
        rows = rows.where(F.col("status") == "active")
    if f.source_in == [] or f.tags_all == []:
        return rows.where(F.lit(False))
    for condition in f.columns():
        rows = rows.where(condition)
    return _tagged(state, rows, f)
