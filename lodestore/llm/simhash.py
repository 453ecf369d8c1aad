"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that are equal are one (a group of copies of any size is one row from there on).
Two fingerprints that differ in at most 3 of 64 bits agree in one of four 16-bit blocks, so each
distinct one goes to four buckets (block, value). A bucket of more than BUCKET fingerprints is
dealt on: its members agree in the bits so far, so two that link agree in one of four blocks of
the remaining bits, and so on; after four such steps at most 2^20 different fingerprints can
share a bucket. Nothing is dropped.

Within a bucket the fingerprints are sorted by Gray rank (neighbours then share long bit
patterns), and a hierarchy is built over them: a node over FAN children holds the mask of the bits
all below it share and their pattern; a child's mask holds the rest. A search goes down from the
bucket's root, adds the differences of each node's own masked bits, and leaves a whole group once
the sum is over 3; at the leaves the sum is the exact distance. (After Tang et al., "Efficient
Processing of Hamming-Distance-Based Similarity-Search Queries Over MapReduce", EDBT 2015.)
Each task joins the links it finds at once and passes on one edge a fingerprint at most; the
edges' components are found with star contraction.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link
like any other. One or two words: one shingle of all. Rows that repeat a doc_id are documents of
that id. An empty table gives an empty result. Bytes are compared as UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..deploy import ship
from .components import components, local_roots
from .shared import join_in_place, join_on_groups, packed_rows, release, small, written
from .tokens import slices

WORDS, SEED, DISTANCE = 3, 42, 3
FAN, BUCKET, BLOCK_PAIRS = 8, 50_000, 1 << 21


def _sum_bits(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text (UTF-8); counts are summed over parts of its shingles."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: A-Z, and space and \\t to \\r, only
    if not found:
        return 0
    if len(found) <= words:
        return xxh64_intdigest(b" ".join(found), seed)
    shingles, n = map(b" ".join, zip(*(found[i:] for i in range(words)))), len(found) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        ones += _sum_bits([xxh64_intdigest(s, seed) for _, s in zip(range(min(n - at, 1 << 15)), shingles)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        for part in slices(batch, 2048):
            *own, text = part.columns
            prints = np.array([fingerprint(t or b"") for t in text.to_pylist()], dtype=np.uint64)
            yield pa.record_batch([*own, pa.array(prints.view(np.int64))], names=[*part.schema.names[:-1], "print"])
    release()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, print long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies over codes that are sorted by (bucket, Gray rank), one for each bucket, all
    levels of all of them in arrays. levels[0] are the codes themselves."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        self.codes = codes
        full = np.full(len(codes), ~np.uint64(0))
        firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(codes) else np.zeros(0, int)
        self.levels, pattern, mask, start = [], codes.copy(), full, firsts
        while True:
            size = np.diff(np.append(start, len(pattern)))
            self.levels.append([pattern, mask, None])
            if (size <= 1).all():
                break
            group = (np.arange(len(pattern)) - np.repeat(start, size)) // FAN
            new = np.concatenate([[True], (group[1:] != group[:-1])])
            new[start] = True
            heads = np.flatnonzero(new)
            head = pattern[heads]
            agree = ~(pattern ^ np.repeat(head, np.diff(np.append(heads, len(pattern))))) & mask
            up_mask = np.bitwise_and.reduceat(agree, heads)
            self.levels[-1][2] = heads  # where each parent's children start
            start = np.searchsorted(heads, start)
            pattern, mask = head & up_mask, up_mask
        self.root = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(codes))))
        # what a node adds to its parent's mask
        for (pattern, mask, heads), (_, above, _) in zip(self.levels, self.levels[1:]):
            own = mask & ~np.repeat(above, np.diff(np.append(heads, len(pattern))))
            pattern &= own
            mask &= own

    def links(self, most: int = DISTANCE):
        """Pairs (a, b), a < b, of rows of one bucket at a distance of at most `most`, in parts."""
        step = max(1, BLOCK_PAIRS // 512)
        for at in range(0, len(self.codes), step):
            query = np.arange(at, min(at + step, len(self.codes)))
            node, sum_ = self.root[query], np.zeros(len(query), dtype=np.int64)
            yield from self._down(len(self.levels) - 1, query, node, sum_, most)

    def _down(self, level, query, node, sum_, most):
        while True:
            pattern, mask, _ = self.levels[level]
            sum_ = sum_ + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
            near = sum_ <= most
            query, node, sum_ = query[near], node[near], sum_[near]
            if not level:
                apart = node > query
                yield query[apart], node[apart]
                return
            heads = self.levels[level - 1][2]
            ends = np.append(heads[1:], len(self.levels[level - 1][0]))
            fan = ends[node] - heads[node]
            if int(fan.sum()) > BLOCK_PAIRS and len(query) > 1:  # halves, so that memory stays bounded
                half = len(query) // 2
                for part in (slice(0, half), slice(half, None)):
                    yield from self._children(level, query[part], node[part], sum_[part], heads, fan[part], most)
                return
            query, node, sum_, level = (*self._expand(query, node, sum_, heads, fan), level - 1)

    def _expand(self, query, node, sum_, heads, fan):
        inside = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
        return np.repeat(query, fan), np.repeat(heads[node], fan) + inside, np.repeat(sum_, fan)

    def _children(self, level, query, node, sum_, heads, fan, most):
        yield from self._down(level - 1, *self._expand(query, node, sum_, heads, fan), most)


def _link(batches):
    """Edges (src, dst) to local roots from rows (bucket, print), a whole bucket at a time; small
    buckets are taken together."""

    def edges(held):
        table = pa.Table.from_batches(held)
        bucket = table.column("bucket").to_numpy()
        codes = table.column("print").to_numpy().view(np.uint64)
        size = np.bincount(np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])))
        several = np.repeat(size > 1, size)
        bucket, codes = bucket[several], codes[several]
        if not len(codes):
            return
        order = np.lexsort((gray_rank(codes), bucket))
        bucket, codes = bucket[order], codes[order]
        parent = np.arange(len(codes))
        for a, b in GrayIndex(codes, bucket).links():
            parent = local_roots(a, b, parent)
        linked = parent != np.arange(len(parent))
        if linked.any():
            yield pa.record_batch([pa.array(codes[linked].view(np.int64)), pa.array(codes[parent[linked]].view(np.int64))], names=["src", "dst"])

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n > BUCKET:
            buckets = batch.column("bucket").to_numpy()
            last = held[-1].column("bucket")[-1].as_py()
            cut = int(np.searchsorted(buckets != last, True)) if buckets[0] == last else 0
            if cut < batch.num_rows:
                held.append(batch.slice(0, cut))
                yield from edges(held)
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield from edges(held)


def buckets_of(prints: DataFrame) -> DataFrame:
    """(bucket, print): four rows for each print, more for those of large buckets. A bucket's key is a
    hash of the masks and values fixed so far; if two keys were equal, links would be none the fewer."""
    full = [(0xFFFF << 16 * i) for i in range(4)]
    level = prints.withColumn("bucket", F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in full)))).select("print", F.col("bucket.mask").alias("mask"), F.xxhash64("bucket").alias("bucket"))
    level = written(level, "buckets")
    out, masks = None, full
    for step in range(4):
        counts = level.groupBy("bucket").count().where(F.col("count") > BUCKET)
        hot = counts.count() if step < 3 else 0  # at most 4^(step + 1) * prints / BUCKET
        if not hot:
            return level.select("bucket", "print") if out is None else out.unionByName(level.select("bucket", "print"))
        side = small(counts.select("bucket"), hot, 64)
        cool = level.join(side, "bucket", "left_anti").select("bucket", "print")
        out = cool if out is None else out.unionByName(cool)
        split = {m: [m | p for p in _blocks(m)] for m in masks}
        masks = sorted({x for v in split.values() for x in v})
        chosen = F.coalesce(*(F.when(F.col("mask") == F.lit(_signed(m)), F.array(*(F.lit(_signed(x)) for x in v))) for m, v in split.items()))
        level = level.join(side, "bucket", "left_semi").withColumn("mask", F.explode(chosen))
        level = written(level.select("print", "mask", F.xxhash64("bucket", "mask", F.col("print").bitwiseAND(F.col("mask"))).alias("bucket")), "buckets")
    return out


def _blocks(mask: int) -> list[int]:
    """Four masks that share out the bits not in mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // 4 for k in range(5)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    rows = written(fingerprints(docs, id_col, text_col), "prints")
    found = _in_components(rows, F.min("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _in_components(rows: DataFrame, least: Column) -> DataFrame:
    """rows (print, ...) with component_id: the least of its component, by an aggregate that is a minimum."""
    spark = rows.sparkSession
    prints = written(rows.groupBy("print").agg(least.alias("least"), F.count("*").alias("n")), "distinct-prints")
    placed = buckets_of(prints.select("print"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = placed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_link, "src long, dst long")
    roots = components(edges)
    labelled = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    labelled = written(labelled, "rooted")
    of_root = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    total = rows.count()
    heavy_at = max(1000, total // 10_000)
    many = of_root.where(F.col("prints") >= heavy_at).count()
    labelled = written(join_on_groups(labelled, of_root, "root", many, heavy_at, "prints").select("print", "component_id", "n"), "labelled")
    heavy = labelled.where(F.col("n") >= heavy_at).count()
    return join_on_groups(rows, labelled, "print", heavy, heavy_at, "n")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null last), of equal ids the one of the
    smallest text hash. Rows are told apart by a written key, so ids may be null or repeated."""
    ship(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")
    rows = written(packed_rows(docs, _row=F.monotonically_increasing_id(), _id=id_, _text_hash=F.xxhash64(text)), "keyed")
    first = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_text_hash").alias("text_hash"), F.col("_row").alias("row"))
    texts = rows.select(first.alias("first"), F.col(f"_doc.`{text_col}`").cast("binary").alias("text"))
    prints = written(texts.mapInArrow(_fingerprints, StructType([*texts.schema.fields[:1], StructField("print", LongType())])), "prints")
    gone = _in_components(prints, F.min("first")).where(F.col("first.row") != F.col("component_id.row")).select(F.col("first.row").alias("_gone"))
    gone = written(gone, "gone")
    return join_in_place(rows, gone, "_row", "_gone", gone.count(), 64, "left_anti", "kept").select("_doc.*")
