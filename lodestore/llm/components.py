"""Connected components of an edge table, by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_on_groups, written

HEAVY_AT, HEAVY_PARTS = 1000, 10_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(src, m): the smallest dst of each src; and rows joined with it. Rows of a src that has many (a
    large star's centre) stay where they are."""
    least = rows.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("_n"))
    heavy_at = max(HEAVY_AT, total // HEAVY_PARTS)
    heavy = least.where(F.col("_n") >= heavy_at).count() if total >= heavy_at else 0
    return least, join_on_groups(rows, least, "src", heavy, heavy_at, "_n")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """edges (src long, dst long) -> (node, root): root is the smallest node that node reaches.
    Nodes without an edge to another are not in it. Each round's edges are written to the shared
    folder; only a count and a checksum come to the driver."""
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.union(edges.select("dst", "src"))
        _, joined = _with_least(both, 2 * state[0])
        large = joined.where("dst > src").select(F.col("dst").alias("src"), F.least("src", "m").alias("dst")).where("src <> dst").distinct()
        low, joined = _with_least(large, state[0])
        down = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        edges = written(down.union(low.select("src", "m")).distinct(), "edges")
        state, last = _state(edges), state
        if state == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(edges.select("dst", "dst").distinct())


def local_roots(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Merges the pairs (a, b) of row numbers into parent, a forest that points to lower rows;
    afterwards each row points to its root."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
