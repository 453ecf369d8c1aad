"""The engine's tables at one moment. Operators take a state and give rows, or a new state."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    """A store's commit: its number, each table's place, and the tables as they were read."""

    number: int
    places: dict[str, str]
    tables: dict[str, DataFrame]


@dataclass(frozen=True)
class MemoryState:
    memory: DataFrame
    embeddings: DataFrame
    entities: DataFrame
    relations: DataFrame
    memory_tags: DataFrame
    postings: DataFrame | None = None  # the stored keyword index, if there is one
    origin: Snapshot | None = None  # what a store loaded it from

    def with_(self, **tables: DataFrame) -> MemoryState:
        return replace(self, **tables)

    def tags_by_memory(self) -> DataFrame:
        return self.memory_tags.groupBy("memory_uuid").agg(F.array_sort(F.collect_set("tag")).alias("tags"))

    def with_tags(self, memory: DataFrame | None = None) -> DataFrame:
        """Memory rows with their tags, sorted; [] where there are none."""
        rows = self.memory if memory is None else memory
        tags = self.tags_by_memory().withColumnRenamed("memory_uuid", "uuid")
        return rows.join(tags, "uuid", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
