"""Expiry and staleness on a clock, remembering from a stream, and access counts from events. Batches of
a stream don't overlap, so a tick never runs into the one before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forget, writes
from ..sources.store import Store


@dataclass
class JobStats:
    ticks: int = 0
    expired: int = 0
    collected: int = 0
    remembered: int = 0
    duplicates: int = 0


class Lifecycle:
    """Expiry at each tick, staleness once gc_every seconds have passed since it last ran."""

    def __init__(self, store: Store, clock: Callable[[], int], gc_every: int = 600, gc_enabled: bool = True, action: str = "archive", **policy):
        self.store, self.clock, self.gc_every, self.gc_enabled, self.action, self.policy = store, clock, gc_every, gc_enabled, action, policy
        self.stats, self.last_gc = JobStats(), None

    def tick(self) -> JobStats:
        now, state = self.clock(), self.store.load()
        due = state.memory.where((F.col("status") == "active") & (F.col("expires_at") < now)).count()
        new = forget.expire(state, now) if due else state
        gone = 0
        if self.gc_enabled and (self.last_gc is None or now - self.last_gc >= self.gc_every):
            gone = forget.stale(new, now, **self.policy).count()
            new = forget.collect_stale(new, now, self.action, **self.policy) if gone else new
            self.last_gc = now
        if new is not state:
            self.store.commit(new)
        self.stats.ticks += 1
        self.stats.expired += due
        self.stats.collected += gone
        return self.stats

    def start(self, spark, every: str = "60 seconds", checkpoint: str | None = None):
        """A query that ticks with the trigger; stop() ends it after the current tick."""
        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = clock.writeStream.foreachBatch(lambda _, __: self.tick() and None).trigger(processingTime=every)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def remember_stream(store: Store, source: DataFrame, clock: Callable[[], int], checkpoint: str, embed=None, dims: int = 64, stats: JobStats | None = None, available_now: bool = True):
    """Remembers each batch of a stream (uuid, content, source, importance, tags). A batch that is run
    again after a failure finds its rows there and adds none."""
    stats = stats if stats is not None else JobStats()

    def batch(rows: DataFrame, _: int) -> None:
        numbered = rows.withColumn("seq", F.monotonically_increasing_id())
        state, out = writes.remember(store.load(), numbered, clock(), embed, dims)
        counts = dict(out.groupBy("duplicate").count().collect())
        store.commit(state)
        stats.remembered += counts.get(False, 0)
        stats.duplicates += counts.get(True, 0)

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def access_counts(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Accesses by memory and hour from a stream of (memory_uuid, ts), late ones within the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour"), "memory_uuid").agg(F.count("*").alias("n"))
