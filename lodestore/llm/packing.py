"""Documents packed into sequences by the sum-of-squares rule.

1. Each text is encoded where it is read; only its pieces' lengths and checksums go on. A
   document longer than a sequence is cut so that its first piece is the shorter one; full pieces
   are sequences of their own.
2. The other pieces are dealt by hash into parts of some PART_ROWS; a part is packed in falling
   order of length. A piece goes to where the sum of squared counts of open bins by gap, over all
   gaps, becomes smallest (Csirik et al., "On the Sum-of-Squares Algorithm for Bin Packing");
   equal sums: to the smallest gap. Then the bins with a gap of SPARE tokens or more are emptied and
   their pieces packed again by the same rule, as long as that saves bins.
3. Pieces in such bins of all parts are dealt again, into a sixteenth as many parts, until there
   is one part. So parts cost next to nothing, and no task grows with the corpus.

Defined results: null text: empty, one piece with the end id. Rows that repeat a doc_id are
packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .shared import release, written
from .tokens import encoder, slices, tokenizer_path

PART_ROWS, SPARE = 60_000, 8


def _pieces(path: str, size: int, end_id: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            out = []
            for part in slices(batch):
                for doc, row, data in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), encode.encode(part.column(1).to_pylist())):
                    ids = np.append(np.frombuffer(data, encode.dtype), encode.dtype.type(end_id)).astype("<u4")
                    first = (len(ids) - 1) % size + 1
                    for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), size)], range(first, len(ids) + 1, size))):
                        out.append((doc, row, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
        release()

    return run


def pack_lengths(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length (each 1 to size), in the given order, by the sum-of-squares rule."""
    counts = np.zeros(size + 1, dtype=np.int64)  # of open bins by gap
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, made = np.empty(len(lengths), dtype=np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        there = counts[n:size]  # by gap from n on; (c - 1)^2 - c^2 + (d + 1)^2 - d^2 = 2 (d - c + 1)
        change = 2 * (counts[: size - n] - there) + 2
        best = -1
        if len(change):
            change[0] -= 1  # a bin that is filled up isn't open, so d is 0 and doesn't become 1
            change[there == 0] = 1 << 60
            best = int(change.argmin())
        if best >= 0 and change[best] <= 2 * counts[size - n] + 1:
            bins[i], gap = stacks[best + n].pop(), best
            counts[best + n] -= 1
        else:
            bins[i], gap, made = made, size - n, made + 1
        if gap:
            stacks[gap].append(bins[i])
            counts[gap] += 1
    return bins


def pack_again(lengths: np.ndarray, size: int) -> np.ndarray:
    """The same, lengths taken in falling order; bins that stay open are emptied and packed again."""
    bins, todo, base = np.full(len(lengths), -1, dtype=np.int64), np.argsort(-lengths, kind="stable"), 0
    before = None
    while len(todo):
        found = pack_lengths(lengths[todo], size)
        n = int(found.max()) + 1
        if before is not None and n >= before:
            break
        bins[todo] = base + found
        fill = np.bincount(found, weights=lengths[todo])
        again = fill[found] <= size - SPARE
        before, base, todo = len(np.unique(found[again])), base + n, todo[again]
    return np.unique(bins, return_inverse=True)[1].astype(np.int64)


def _pack(size: int, level: int, last: bool):
    """Final pieces get sequence and offset; those of bins still open: sequence null, unless last."""

    def run(batches):
        from .token_store import _column, _runs

        for part, table in _runs(batches, "part"):
            length = _column(table, "length").to_numpy(zero_copy_only=False)
            bins = pack_again(length, size)
            fill = np.bincount(bins, weights=length).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            inside = np.empty(len(bins), dtype=np.int64)
            inside[order] = np.cumsum(length[order]) - length[order] - (np.cumsum(fill) - fill)[bins[order]]
            done = np.full(len(bins), True) if last else fill[bins] > size - SPARE
            sequence = (np.int64(level + 1) << 58) + (np.int64(part) << 20) + bins
            names = ["row", "piece", "start", "length", "ids_crc32", "doc_id"]
            yield pa.record_batch([*(_column(table, c) for c in names), pa.array(sequence, mask=~done), pa.array(inside, mask=~done)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = "doc_id long, row long, piece long, start long, length long, ids_crc32 long"
    pieces = written(rows.mapInArrow(_pieces(path or tokenizer_path(), size, end_id), schema), "pieces")
    out = pieces.where(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size)
    parts, level = max(1, -(-rest.count() // PART_ROWS)), 0
    while True:
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts))).repartition(parts, "part").sortWithinPartitions("part", F.desc("length"), "row", "piece")
        packed = written(dealt.mapInArrow(_pack(size, level, parts == 1), "row long, piece long, start long, length long, ids_crc32 long, doc_id long, sequence_id long, offset long"), "packed")
        out = out.unionByName(packed.where("sequence_id IS NOT NULL").select(out.columns))
        if parts == 1:
            return out
        rest, level = packed.where("sequence_id IS NULL").drop("sequence_id", "offset"), level + 1
        parts = max(1, min(parts // 16, -(-rest.count() // PART_ROWS)))
