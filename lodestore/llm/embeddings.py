"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are compared when they have one label. Equal vectors are one row with a count. Principal
axes are fitted on at most SAMPLE vectors (lowest hashes) of the commonest length; they only order
the work, so any rotation gives the same links. Unit vectors at cosine t differ by at most
sqrt(2 - 2t) on any axis, so a vector is compared with the cells next to its own on the first two
axes only. Cells are cut into blocks of at most BLOCK rows, and each pair of blocks of neighbouring
cells is one task: a cell of any size is dealt over many. Within a task, products are summed over the
leading axes first; what the others can add is bounded by the product of suffix norms, and pairs (at
first whole tiles) that can't reach the threshold are left. Those that stay to the end are decided
by the cosine of the vectors as they are, in double precision. A task passes on each vector's number
of links and one edge to its local root, never the pairs.

Defined results: a vector with a null label, or that is null, empty, zero, or has null or
non-finite components, links with nothing (n_links 0, its own component). Vectors of different
lengths don't link. Rows that repeat a vec_id are vectors of that id. An empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .components import components, local_roots
from .shared import join_on_groups, small, written

THRESHOLD, SAMPLE, BLOCK, TILE = 0.98, 10_000, 2048, 256
STEPS = (4, 8, 16, 32)  # axes after which a tile is looked at
SLACK = 1e-9


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Columns: orthonormal axes by falling variance of the unit vectors (about the origin)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def _rotated(raw: np.ndarray, axes: np.ndarray) -> np.ndarray:
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return unit @ axes if len(axes) == raw.shape[1] else unit


def tile_links(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, threshold: float):
    """Rows (i, j) whose cosine reaches the threshold. x and y are unit vectors on ordered axes."""
    dims = x.shape[1]
    steps = [s for s in STEPS if s < dims]
    i = j = None
    sum_ = np.zeros((len(x), len(y)))
    done = 0
    for step in steps:
        rest_x, rest_y = np.linalg.norm(x[:, step:], axis=1), np.linalg.norm(y[:, step:], axis=1)
        if i is None:
            sum_ += x[:, done:step] @ y[:, done:step].T
            open_ = sum_ + np.outer(rest_x, rest_y) >= threshold - SLACK
            n = np.count_nonzero(open_)
            if not n:
                return np.zeros(0, int), np.zeros(0, int)
            if n * 8 < open_.size:  # few left: on with single pairs
                i, j = np.nonzero(open_)
                sum_ = sum_[i, j]
        else:
            sum_ = sum_ + np.einsum("ij,ij->i", x[i, done:step], y[j, done:step])
            open_ = sum_ + rest_x[i] * rest_y[j] >= threshold - SLACK
            i, j, sum_ = i[open_], j[open_], sum_[open_]
        done = step
    if i is None:
        i, j = np.nonzero(sum_ + x[:, done:] @ y[:, done:].T >= threshold - SLACK)
    else:
        open_ = sum_ + np.einsum("ij,ij->i", x[i, done:], y[j, done:]) >= threshold - SLACK
        i, j = i[open_], j[open_]
    exact = np.einsum("ij,ij->i", raw_x[i], raw_y[j]) / (np.linalg.norm(raw_x[i], axis=1) * np.linalg.norm(raw_y[j], axis=1))
    return i[exact >= threshold], j[exact >= threshold]


def _compare(axes: np.ndarray, threshold: float):
    """Links within one task's rows (task, side, id, count, vector). side 0 is compared with side 1,
    or, where there is no side 1, with itself."""

    def run(batches):
        from .token_store import _column, _runs

        for _, table in _runs(batches, "task"):
            side = _column(table, "side").to_numpy(zero_copy_only=False)
            both = bool(_column(table, "both")[0].as_py())
            if both and not (0 < side.sum() < len(side)):
                continue
            ids, count = (_column(table, c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            raw = np.array(_column(table, "vector").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
            turned = _rotated(raw, axes)
            order = np.lexsort((turned[:, 0], side))  # tiles of neighbours
            raw, turned, ids, count, side = raw[order], turned[order], ids[order], count[order], side[order]
            first = int(np.searchsorted(side, 1)) if both else len(ids)
            left = [(a, min(a + TILE, first)) for a in range(0, first, TILE)]
            right = [(a, min(a + TILE, len(ids))) for a in range(first, len(ids), TILE)] if both else left
            links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
            for a, b in left:
                for c, d in right:
                    if not both and c < a:
                        continue
                    if turned[c, 0] - turned[b - 1, 0] > reach or turned[a, 0] - turned[d - 1, 0] > reach:
                        continue
                    i, j = tile_links(turned[a:b], turned[c:d], raw[a:b], raw[c:d], threshold)
                    i, j = i + a, j + c
                    if not both:
                        apart = i < j
                        i, j = i[apart], j[apart]
                    if len(i):
                        np.add.at(links, i, count[j])
                        np.add.at(links, j, count[i])
                        parent = local_roots(i, j, parent)
            some = links > 0
            if some.any():
                yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[parent[some]])], names=["id", "links", "root"])

    return run


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    ship(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False)))
    key = F.when(F.col("usable"), F.unhex(F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.col("vector").cast("array<string>"), ",")), 256)))
    rows = written(rows.withColumn("key", key), "vectors")
    total = rows.count()
    groups = rows.where("usable").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")  # ids of vectors may repeat
    lengths = groups.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = lengths["d"] if lengths else 0
    sample = [r["vector"] for r in groups.where(F.size("vector") == dims).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").collect()] if dims else []
    axes = principal_axes(np.array(sample)) if sample else np.zeros((0, 0))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)

    def cell(k: int):
        axis = F.array(*(F.lit(float(v)) for v in axes[:, k])) if len(axes) > k else F.lit(None).cast("array<double>")
        at = F.aggregate(F.zip_with("vector", axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / norm
        return F.when(F.size("vector") == dims, F.floor(at / width)).otherwise(0).cast("int")

    placed = groups.select("id", "n", "vector", "label", F.size("vector").alias("d"), cell(0).alias("c0"), cell(1).alias("c1"))
    placed = written(placed, "cells")
    cells = written(placed.groupBy("label", "d", "c0", "c1").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")), "cell-counts")
    n_cells = cells.count()

    # pairs of neighbouring cells, the own one included, each once: a cell and the one at (dx, dy) from it
    steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    there = cells.select(F.col("label").alias("l2"), F.col("d").alias("d2"), F.col("c0").alias("x2"), F.col("c1").alias("y2"), F.col("blocks").alias("blocks2"))
    pairs = cells.withColumn("s", F.explode(steps)).join(there, (F.col("label") == F.col("l2")) & (F.col("d") == F.col("d2")) & (F.col("c0") + F.col("s.dx") == F.col("x2")) & (F.col("c1") + F.col("s.dy") == F.col("y2")))
    pairs = pairs.select("label", "d", "c0", "c1", "s.dx", "s.dy", F.col("blocks").alias("b1"), F.col("blocks2").alias("b2"))
    own = pairs.select(F.col("label").alias("pl"), F.col("d").alias("pd"), F.col("c0").alias("px"), F.col("c1").alias("py"), "dx", "dy", F.lit(0).alias("side"), "b1", "b2")
    far = pairs.where("dx <> 0 OR dy <> 0").select(F.col("label").alias("pl"), F.col("d").alias("pd"), (F.col("c0") + F.col("dx")).alias("px"), (F.col("c1") + F.col("dy")).alias("py"), "dx", "dy", F.lit(1).alias("side"), "b1", "b2")
    plan = own.unionByName(far)
    met = placed.join(small(plan, 9 * n_cells, 96), (F.col("label") == F.col("pl")) & (F.col("d") == F.col("pd")) & (F.col("c0") == F.col("px")) & (F.col("c1") == F.col("py")))
    same = (F.col("dx") == 0) & (F.col("dy") == 0)
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b2"))).cast("int")
    met = met.withColumn("mine", mine)
    # the other's blocks; in the own cell each pair of blocks once, where the lower one is side 0
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b2")).otherwise(F.col("b1")) - 1)
    met = met.withColumn("other", F.explode(others))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(same, (F.col("mine") > F.col("other")).cast("int")).otherwise(F.col("side"))
    a = F.when(same, low).when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other"))
    b = F.when(same, high).when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))
    x, y = F.when(F.col("side") == 0, F.col("c0")).otherwise(F.col("c0") - F.col("dx")), F.when(F.col("side") == 0, F.col("c1")).otherwise(F.col("c1") - F.col("dy"))
    task = F.struct("label", "d", x.alias("x"), y.alias("y"), "dx", "dy", a.alias("a"), b.alias("b"))
    tasks = met.select(F.xxhash64(task).alias("task"), side.alias("side"), (~same | (F.col("mine") != F.col("other"))).alias("both"), "id", "n", "vector")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tasks.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_compare(axes, threshold), "id long, links long, root long")
    found = written(found, "vector-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    labelled = groups.select("key", "id", "n", "least").join(sums, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    labelled = written(labelled.select("key", "n", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root")), "rooted-vectors")
    of_root = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    heavy_at = max(1000, total // 10_000)
    many = of_root.where(F.col("members") >= heavy_at).count()
    labelled = written(join_on_groups(labelled, of_root, "root", many, heavy_at, "members").select("key", "n", "n_links", "component_id"), "labelled-vectors")
    heavy = labelled.where(F.col("n") >= heavy_at).count()
    linked = join_on_groups(rows.where("usable").select("vec_id", "key"), labelled, "key", heavy, heavy_at, "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
