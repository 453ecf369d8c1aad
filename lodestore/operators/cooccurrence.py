"""Ordered pairs of names that share a text, each once. Pairs grow with the square of a text's names, so they
aren't shuffled: texts are dealt as lists of ids into cells of two blocks of names, and a cell's pairs are made,
and made distinct, in one task's numpy."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StorageError

#: Pairs that a task holds at once (a name in more texts than that goes alone), and rows of a batch that it gives.
PAIRS, ROWS = 2_000_000, 100_000
_DEALT = "cell int, id long, uuid string, ids binary, places binary, sizes binary"


def across(spark) -> int:
    """Blocks of names: a third as many cells as there are shuffle partitions, three at least."""
    return max(2, ceil(sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")) / 2)))


def cells(blocks: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(blocks) for q in range(p, blocks)]


def ordered_pairs(lists: DataFrame, names: DataFrame, blocks: int | None = None) -> DataFrame:
    """lists (ids array<long>: a text's names in order), names (id, uuid), one row an id: (source_uuid,
    target_uuid) of each two different ids of which the first comes before the second in some text."""
    blocks = blocks or across(lists.sparkSession)
    grid = cells(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).drop_null()
            ids, of = found.flatten().to_numpy(zero_copy_only=False), found.value_lengths().to_numpy(zero_copy_only=False)
            text, block = np.repeat(np.arange(len(of)), of), ids % blocks
            rows: dict[str, list] = {c: [] for c in ("cell", "ids", "places", "sizes")}
            for k, (p, q) in enumerate(grid):
                inside = np.flatnonzero((block == p) | (block == q))
                own = np.bincount(text[inside], minlength=len(of))
                inside = inside[own[text[inside]] > 1]  # a name alone makes no pair
                if len(inside):
                    known, places = np.unique(ids[inside], return_inverse=True)
                    for c, value in (("cell", k), ("ids", known.astype("<i8").tobytes()), ("places", places.astype("<u4").tobytes()), ("sizes", own[own > 1].astype("<u4").tobytes())):
                        rows[c].append(value)
            n = len(rows["cell"])
            yield pa.RecordBatch.from_arrays([pa.array(rows["cell"], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *[pa.array(rows[c], pa.binary()) for c in ("ids", "places", "sizes")]], names=["cell", "id", "uuid", "ids", "places", "sizes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if cell[a] != at:
                    yield from _pairs(held, at, grid, blocks)
                    at, held = int(cell[a]), []
                held.append(batch.slice(a, b - a))
        yield from _pairs(held, at, grid, blocks)

    # a block's names go to each cell that it is in
    of_block = F.array(*[F.array(*[F.lit(k) for k, pq in enumerate(grid) if b in pq]) for b in range(blocks)])
    binary = [F.lit(None).cast("binary").alias(c) for c in ("ids", "places", "sizes")]
    dealt = names.select(F.explode(F.get(of_block, F.pmod(F.col("id"), F.lit(blocks)).cast("int"))).alias("cell"), "id", "uuid", *binary)
    dealt = dealt.unionByName(lists.select("ids").mapInArrow(deal, _DEALT))
    dealt = dealt.repartitionById(len(grid), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(meet, "source_uuid string, target_uuid string")


def _pairs(held: list[pa.RecordBatch], cell: int | None, grid: list[tuple[int, int]], blocks: int) -> Iterator[pa.RecordBatch]:
    """A cell's pairs: of two different blocks in either order, or within one block."""
    if not held:
        return
    rows = pa.Table.from_batches(held)
    named, texts = rows.filter(rows["id"].is_valid()), rows.filter(rows["ids"].is_valid())
    ids = named["id"].to_numpy()
    order = np.argsort(ids)
    ids, uuids = ids[order], named["uuid"].combine_chunks().take(pa.array(order))
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        raise StorageError("two names have one id")
    places, sizes = [], []
    for known, place, size in zip(texts["ids"].to_pylist(), texts["places"].to_pylist(), texts["sizes"].to_pylist()):
        known = np.frombuffer(known, "<i8")
        found = np.searchsorted(ids, known)
        if len(ids) == 0 or (ids[np.minimum(found, len(ids) - 1)] != known).any():
            raise StorageError("a text's name has no id")
        places.append(found[np.frombuffer(place, "<u4")])
        sizes.append(np.frombuffer(size, "<u4").astype(np.int64))
    if not places:
        return
    names, sizes = np.concatenate(places), np.concatenate(sizes)
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(names)) - 1  # names after this one in its text
    block, mixed = ids % blocks, grid[cell][0] != grid[cell][1]
    order = np.argsort(names, kind="stable")
    total = np.cumsum(after[order])
    ends = np.append(np.flatnonzero(np.diff(names[order])) + 1, len(order))  # where a first name's places end
    begin = done = 0
    while begin < len(order):
        upto = np.searchsorted(total[ends - 1], done + PAIRS, side="right")  # whole names, one at least
        end = int(ends[max(upto, np.searchsorted(ends, begin, side="right") + 1) - 1])
        part = order[begin:end]
        n = after[part]
        target = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - part - 1, n)
        first, second = np.repeat(names[part], n), names[target]
        if mixed:
            apart = block[first] != block[second]
            first, second = first[apart], second[apart]
        pairs = np.unique(first * len(ids) + second)
        first, second = np.divmod(pairs, len(ids))
        first, second = first[first != second], second[first != second]
        for a in range(0, len(first), ROWS):
            yield pa.RecordBatch.from_arrays([uuids.take(pa.array(x[a : a + ROWS])) for x in (first, second)], names=["source_uuid", "target_uuid"])
        begin, done = end, int(total[end - 1])
