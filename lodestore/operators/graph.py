"""The entity graph: traversal, expansion of results, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..state import MemoryState
from .cut import cut

DEPTH_CAP, NODE_CAP, EXPAND_DEPTH_CAP = 8, 1024, 6


def adjacency(relations: DataFrame, direction: str = "both", whitelist: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """(u, v, dir, edge): 0 along an edge, 1 against it. The last two arguments are an extension."""
    if direction not in ("out", "in", "both"):
        raise ValidationError(f"unknown direction {direction!r}")
    if whitelist is not None:
        relations = relations.where(F.col("predicate").isin(whitelist))
    if min_confidence is not None:
        relations = relations.where(F.col("confidence") >= min_confidence)
    out = relations.select(F.col("source_uuid").alias("u"), F.col("target_uuid").alias("v"), F.lit(0).alias("dir"), F.col("uuid").alias("edge"))
    back = relations.select(F.col("target_uuid").alias("u"), F.col("source_uuid").alias("v"), F.lit(1).alias("dir"), F.col("uuid").alias("edge"))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def bfs_depth(relations: DataFrame, starts: DataFrame, max_depth: int = 2, **edges) -> DataFrame:
    """(uuid, depth) of all nodes within max_depth steps of any of starts (uuid): one pass from all
    starts at once, level by level, each level new nodes only and written once."""
    adj = adjacency(relations, **edges).select("u", "v")
    seen = level = cut(starts.select("uuid", F.lit(0).alias("depth")).distinct())
    for depth in range(1, min(max_depth, DEPTH_CAP) + 1):
        reached = adj.join(level.select(F.col("uuid").alias("u")), "u", "left_semi").select(F.col("v").alias("uuid")).distinct()
        level = cut(reached.join(seen, "uuid", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def traverse(relations: DataFrame, start: str, max_depth: int = 2, max_nodes: int = 200, **edges) -> DataFrame:
    """(uuid, depth, position, path) in the order of discovery: a node's neighbours along edges come
    first, then those against them, each by edge; a node belongs to the first that reached it. Stops at
    max_nodes. Levels hold at most NODE_CAP rows; only candidates are joined at scale."""
    max_nodes = min(max_nodes, NODE_CAP)
    spark = relations.sparkSession
    adj = adjacency(relations, **edges)
    seen = level = cut(spark.createDataFrame([(start, 0, 0, [start])], "uuid string, depth int, position int, path array<string>"))
    n = 1
    for depth in range(1, min(max_depth, DEPTH_CAP) + 1):
        parents = level.select(F.col("uuid").alias("u"), F.col("position").alias("parent"), F.col("path").alias("way"))
        reached = adj.join(F.broadcast(parents), "u")  # at most NODE_CAP rows
        first = reached.groupBy("v").agg(F.min(F.struct("parent", "dir", "edge", "way")).alias("key")).withColumnRenamed("v", "uuid")
        new = first.join(F.broadcast(seen.select("uuid")), "uuid", "left_anti").orderBy("key").limit(max_nodes - n)
        numbered = new.select("uuid", F.lit(depth).alias("depth"), (F.lit(n - 1) + F.row_number().over(W.orderBy("key"))).alias("position"), F.concat("key.way", F.array("uuid")).alias("path"))
        level = cut(numbered)
        found = level.count()
        if not found:
            break
        seen, n = cut(seen.unionByName(level)), n + found
        if n >= max_nodes:
            break
    return seen


def seed_entities(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Both ends of the relations that the seed memories (uuid) brought."""
    brought = relations.join(seeds.select(F.col("uuid").alias("memory_uuid")), "memory_uuid", "left_semi")
    return brought.select(F.col("source_uuid").alias("uuid")).union(brought.select("target_uuid")).distinct()


def memories_of(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Memories of relations that touch any node: two semi-joins rather than one with OR."""
    with_memory = relations.where(F.col("memory_uuid").isNotNull())
    hits = [with_memory.join(nodes.select(F.col("uuid").alias(c)), c, "left_semi").select("memory_uuid") for c in ("source_uuid", "target_uuid")]
    return hits[0].union(hits[1]).distinct().withColumnRenamed("memory_uuid", "uuid")


def expand(state: MemoryState, seeds: DataFrame, max_depth: int = 2, limit: int = 200, **edges) -> DataFrame:
    """Memories near the seeds' entities, the seeds' own included; by uuid, at most limit."""
    nodes = bfs_depth(state.relations, seed_entities(state.relations, seeds), min(max_depth, EXPAND_DEPTH_CAP), **edges)
    return memories_of(state.relations, nodes).union(seeds.select("uuid")).distinct().orderBy("uuid").limit(limit)


def orphans(state: MemoryState) -> DataFrame:
    """Entities of kind unknown that no relation touches."""
    ends = state.relations.select(F.col("source_uuid").alias("uuid")).union(state.relations.select("target_uuid")).distinct()
    return state.entities.where(F.col("type") == "unknown").join(ends, "uuid", "left_anti")
