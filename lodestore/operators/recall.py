"""Recall: arms, merge by mode, filter, linear ranking. An arm's result (at most some hundred rows) is
materialised, as merge and expansion both read it; the rest is one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.ranking import RankWeights
from ..state import MemoryState
from . import graph, retrieval
from .cut import cut
from .filters import MemoryFilter, for_recall

TOP_CAP = 200
MODES = ("semantic", "keyword", "hybrid")


@dataclass(frozen=True)
class HybridWeights:
    semantic: float = 0.6
    keyword: float = 0.3
    graph: float = 0.1


@dataclass(frozen=True)
class RecallOptions:
    mode: str = "hybrid"
    top_k: int = 20
    similarity_threshold: float = -1.0
    score_threshold: float = 0.0
    weights: RankWeights = field(default_factory=RankWeights)
    hybrid: HybridWeights = field(default_factory=HybridWeights)
    rrf_k: int | None = 25
    filter: MemoryFilter = field(default_factory=MemoryFilter)
    graph_depth: int | None = None  # None: no expansion
    status_scope: str = "active"
    prefilter: bool = False  # an extension: filter before the arms' limits
    strict_query: bool = False


def fetch_k(top_k: int) -> int:
    return max(min(4 * top_k, TOP_CAP), max(top_k, 10))


def candidates(state: MemoryState, query: str | None, vector: list[float] | None, o: RecallOptions) -> DataFrame:
    """(uuid, cosine, from_graph) before filters."""
    if o.mode not in MODES:
        raise ValidationError(f"unknown mode {o.mode!r}")
    if not 0 < o.top_k <= TOP_CAP:
        raise ValidationError(f"top_k must be 1 to {TOP_CAP}")
    k, arms, sims = fetch_k(o.top_k), [], []
    memory, embeddings = state.memory, state.embeddings
    if o.prefilter:
        memory = for_recall(state, memory, o.filter, o.status_scope)
        embeddings = embeddings.join(memory.select(F.col("uuid").alias("memory_uuid")), "memory_uuid", "left_semi")
    if o.mode != "keyword":
        if vector is None:
            raise ValidationError("this mode needs a query vector")
        near = cut(retrieval.knn(embeddings, vector, k, o.similarity_threshold))
        sims.append(near.select("uuid", "cosine"))
        arms.append(retrieval.ranked(near, "semantic", o.hybrid.semantic, F.desc(F.round("cosine", 9)), "uuid"))
    if o.mode != "semantic":
        if not (query or "").strip():
            raise ValidationError("this mode needs a query text")
        statuses = o.filter.status_in or (None if o.status_scope == "unfiltered" else ["active"])
        found = cut(retrieval.bm25(memory, query, k, statuses, o.strict_query, None if o.prefilter else state.postings))
        sims.append(found.select("uuid", (2 * F.col("score") - 1).alias("cosine")))
        arms.append(retrieval.ranked(found, "keyword", o.hybrid.keyword, F.round("bm25", 9), "id"))
    near = None
    if o.graph_depth is not None:
        seeds = sims[0].select("uuid")
        for s in sims[1:]:
            seeds = seeds.union(s.select("uuid"))
        near = cut(graph.expand(state, seeds.distinct(), o.graph_depth, k))
        arms.append(retrieval.ranked(near, "graph", o.hybrid.graph, "uuid"))
    if o.mode == "hybrid":
        live = [a for a, w in zip(arms, (o.hybrid.semantic, o.hybrid.keyword, o.hybrid.graph)) if w > 0]
        if not live:
            return state.memory.where(F.lit(False)).select("uuid", F.lit(0.0).alias("cosine"), F.lit(False).alias("from_graph"))
        union = live[0]
        for a in live[1:]:
            union = union.unionByName(a)
        rows = retrieval.rrf(union, o.rrf_k).orderBy(F.desc(F.round("rrf", 12)), "uuid").limit(min(3 * o.top_k, 400)).select("uuid")
        rows = rows.join(sims[0].withColumnRenamed("cosine", "c0"), "uuid", "left").join(sims[1].withColumnRenamed("cosine", "c1"), "uuid", "left")
        rows = rows.select("uuid", F.coalesce("c0", "c1").alias("cosine"))
    else:
        rows = sims[0]
        if near is not None and o.mode == "semantic":  # keyword mode only flags
            rows = rows.unionByName(near.join(rows, "uuid", "left_anti").select("uuid", F.lit(None).cast("double").alias("cosine")))
    if near is None:
        return rows.withColumn("from_graph", F.lit(False))
    return rows.join(near.select("uuid", F.lit(True).alias("g")), "uuid", "left").select("uuid", "cosine", F.coalesce("g", F.lit(False)).alias("from_graph"))


def filtered(state: MemoryState, query: str | None, vector: list[float] | None, o: RecallOptions) -> DataFrame:
    """Candidates with their memory rows that pass the filter. They are at most a few hundred, so they
    are broadcast to the memory table."""
    found = candidates(state, query, vector, o)
    rows = state.memory.join(F.broadcast(found), "uuid")
    return for_recall(state, rows, o.filter, o.status_scope)


def recall(state: MemoryState, query: str | None, vector: list[float] | None, o: RecallOptions = RecallOptions()) -> DataFrame:
    """The top_k hits: memory columns, cosine, from_graph, components, score."""
    scored = retrieval.rank_linear(filtered(state, query, vector, o), o.weights, o.score_threshold)
    return scored.orderBy(*retrieval.final_order()).limit(o.top_k)


def total_candidates(state: MemoryState, query: str | None, vector: list[float] | None, o: RecallOptions = RecallOptions()) -> DataFrame:
    """How many pass the filter, before the threshold."""
    return filtered(state, query, vector, o).agg(F.count("*").alias("total_candidates"))


def apply_feedback(state: MemoryState, hits: DataFrame, now: int) -> MemoryState:
    """Counts an access for each hit (uuid; several rows count several times)."""
    seen = hits.groupBy("uuid").agg(F.count("*").alias("_n"))
    memory = state.memory.join(seen, "uuid", "left")
    memory = memory.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
    memory = memory.withColumn("last_accessed", F.when(F.col("_n").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_accessed")))
    return state.with_(memory=memory.select(*state.memory.columns))
