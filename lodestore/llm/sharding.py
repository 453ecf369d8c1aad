"""Shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

Groups of equal texts are the indivisible items. Every group of at least total/(shards * PARTS)
bytes is an item of its own (so at most shards * PARTS of them); all lighter groups are hashed
into shards * PARTS bundles. These items, whose number doesn't depend on the corpus, are
differenced on the driver: the two partial partitions with the largest spread are combined, one
in opposite order, until one is left. A group that is larger than a shard's fair share leaves
the others near equal among themselves. Rows are never shuffled by their text.

Defined results: a null text has no bytes and equals the empty text (crc32 0). Repeated rows
and ids are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks_for, running, small, written

PARTS = 1024


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by the largest differencing method for any number of shards."""
    heap, bins = [], {}
    for i, size in enumerate(sizes):
        # sums in falling order, less the smallest; what each holds, as nested pairs
        heap.append((-size, i, (size,) + (0,) * (shards - 1) if shards > 1 else (0,)))
        bins[i] = (i,) + (None,) * (shards - 1)
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        own, other = bins.pop(i), bins.pop(j)
        order = sorted(zip((x + y for x, y in zip(a, reversed(b))), range(shards)), key=lambda x: -x[0])
        least = order[-1][0]
        joined = []
        for _, k in order:
            x, y = own[k], other[shards - 1 - k]
            joined.append(y if x is None else x if y is None else (x, y))
        bins[n] = tuple(joined)
        heapq.heappush(heap, (least - order[0][0], n, tuple(s - least for s, _ in order)))
        n += 1
    found = [0] * len(sizes)
    for held in bins.values():
        for shard, top in enumerate(held):
            stack = [] if top is None else [top]
            while stack:
                x = stack.pop()
                if isinstance(x, tuple):
                    stack += x
                else:
                    found[x] = shard
    return found


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row."""
    spark, text = docs.sparkSession, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bundle = F.pmod(F.xxhash64("_sha"), F.lit(shards * PARTS)).cast("int")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows.withColumn("_bundle", bundle), "sized")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    alone_at = max(1, total // (shards * PARTS))
    groups = written(rows.groupBy("_sha", "_bundle").agg(F.sum("size").alias("_bytes")), "text-groups")
    item = F.when(F.col("_bytes") >= alone_at, F.col("_sha"))
    items = groups.groupBy(item.alias("_alone"), F.when(item.isNull(), F.col("_bundle")).alias("_bundle")).agg(F.sum("_bytes").alias("_bytes"))
    items = sorted(items.collect(), key=lambda r: (-r["_bytes"], bytes(r["_alone"] or b""), r["_bundle"] or 0))  # at most 2 * shards * PARTS and one group more
    where = differencing([r["_bytes"] for r in items], shards)
    alone = spark.createDataFrame([(r["_alone"], s) for r, s in zip(items, where) if r["_alone"] is not None], "_sha binary, _shard_a int")
    bundles = spark.createDataFrame([(r["_bundle"], s) for r, s in zip(items, where) if r["_alone"] is None], "_bundle int, _shard_b int")
    placed = rows.join(small(alone, len(items), 64), "_sha", "left").join(small(bundles, len(items), 32), "_bundle", "left")
    placed = written(placed.select("doc_id", "size", "text_crc32", "_row", F.coalesce("_shard_a", "_shard_b").alias("shard")), "placed")
    block = F.pmod(F.xxhash64("doc_id", "_row"), F.lit(blocks_for(n // shards + 1)))  # rows that repeat an id too are dealt out
    placed = running(placed, ["shard"], block, [F.col("doc_id"), F.col("text_crc32"), F.col("_row")], F.lit(1).cast("long"), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
