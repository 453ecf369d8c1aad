"""Token ids as raw binary shards, found by a minimal perfect hash index.

Shard file: the ids of its documents, one after the other, little-endian, 2 bytes each if the
vocabulary has at most 65,536 ids, else 4. Shards are runs of ascending doc_id. Index file: one
for each bucket of a 64-bit hash of the key. It holds a minimal perfect hash of the bucket's keys
(levels of bit arrays: a key that is alone at its place in a level is there; the others go on to
the next level; its rank among all set bits is its slot; the rank of each BLOCK of words is stored)
and an entry for each slot: fingerprint, shard, offset, length. A look-up hashes the key, reads a
word a level, one block and one entry, and compares the fingerprint; its cost doesn't depend on the
number of keys. manifest.json has the format, shards.json the shards' sums.

Texts are encoded where they are read; ids are what is shuffled, by ranges of (doc_id, hash of the
text) from a sample, so that neither an id nor a text that repeats sits in one task. All files go
to the shared folder under a task's own name and are renamed when complete, so a repeated task
leaves the same files. Defined results: a null text is empty and yields the end id only; a null
doc_id comes first; rows that repeat a doc_id are numbered (occurrence 0, 1, ...) in the order of
their texts' hashes and found by (doc_id, occurrence); an empty table yields no files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from .shared import new_folder, small, written
from .tokens import encoder, slices, tokenizer_path

ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
BLOCK = 8  # 64-bit words of a bit array between two stored ranks
SHARD_BYTES, BUCKET_KEYS = 64 << 20, 1 << 20
ROW_BYTES = 64  # what a row counts besides its text, so that short texts are dealt out too
SAMPLE, A_SHARD = 20_000, 20  # rows for the shards' bounds: so many, or so many for each shard
READ_BYTES = 8 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _fs(path: str):
    return FileSystem.from_uri(path)


class Writer:
    """A file of the shared folder, there whole or not at all."""

    def __init__(self, path: str):
        self.fs, self.name = _fs(path)
        self.fs.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.own, self.length = f"{self.name}.{uuid.uuid4().hex}.part", 0
        self.out = self.fs.open_output_stream(self.own)

    def write(self, data) -> None:
        self.out.write(data)
        self.length += len(data)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.name)


def put(path: str, parts) -> None:
    file = Writer(path)
    for part in parts:
        file.write(part)
    file.done()


def get(path: str) -> bytes:
    fs, name = _fs(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (the finaliser of SplitMix64)."""
    z = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def key_hash(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """The hash of (doc_id, occurrence); a null id is the lowest long, occurrence + 2^40."""
    return mixed(ids.astype(np.int64).view(np.uint64) ^ mixed(occurrence.astype(np.uint64), 7), 0)


class PerfectHash:
    """slot(keys) of distinct 64-bit hashes: 0 to n-1, each once."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)  # in words, by level

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, arrays, level = [], [], 0
        while len(keys):
            if level > 200:
                raise ValueError("two keys have the same hash")
            n = -(-2 * len(keys) // 64)
            place = (mixed(keys, 100 + level) % np.uint64(n * 64)).astype(np.int64)
            alone = np.bincount(place, minlength=n * 64) == 1
            arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n)
            keys, level = keys[~alone[place]], level + 1
        words = np.concatenate(arrays) if arrays else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype("<i8")
        blocks = np.add.reduceat(counts, np.arange(0, len(words), BLOCK)) if len(words) else counts
        return cls(np.array(sizes, dtype="<i8"), words, (np.cumsum(blocks) - blocks).astype("<i8"))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is surely not in; other strangers get some slot, which fingerprints tell."""
        found, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, n in enumerate(self.sizes.tolist()):
            place = (mixed(keys[open_], 100 + level) % np.uint64(n * 64)).astype(np.int64)
            word, bit = self.starts[level] + (place >> 6), (place & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[here], bit[here]
            rank = self.ranks[w // BLOCK] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            for back in range(1, BLOCK):
                inside = w % BLOCK >= back
                rank[inside] += np.bitwise_count(self.words[w[inside] - back])
            found[open_[here]] = rank
            open_ = open_[~here]
        return found


def index_bytes(hashes: np.ndarray, entries: np.ndarray) -> list[bytes]:
    made = PerfectHash.build(hashes)
    table = np.zeros(len(hashes), dtype=ENTRY)
    table[made.slot(hashes)] = entries
    head = np.array([len(hashes), len(made.sizes), len(made.words)], dtype="<i8")
    return [head.tobytes(), made.sizes.tobytes(), made.ranks.tobytes(), made.words.tobytes(), table.tobytes()]


def _places(levels: int, words: int) -> tuple[int, int, int]:
    """Where an index file's ranks, words and entries start."""
    ranks = 24 + 8 * levels
    return ranks, ranks + 8 * -(-words // BLOCK), ranks + 8 * -(-words // BLOCK) + 8 * words


class Index:
    """An index file's contents."""

    def __init__(self, data: bytes):
        n, levels, words = np.frombuffer(data, "<i8", 3).tolist()
        ranks, bits, entries = _places(levels, words)
        self.hash = PerfectHash(np.frombuffer(data, "<i8", levels, 24), np.frombuffer(data, "<u8", words, bits), np.frombuffer(data, "<i8", -(-words // BLOCK), ranks))
        self.table = np.frombuffer(data, ENTRY, n, entries)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries, and whether each key is in (by its fingerprint)."""
        slot = self.hash.slot(hashes)
        if not len(self.table):
            return np.zeros(len(hashes), ENTRY), np.zeros(len(hashes), bool)
        entries = self.table[np.maximum(slot, 0)]
        return entries, (slot >= 0) & (entries["fingerprint"] == fingerprints(hashes))


def find_one(file, h: int) -> np.void | None:
    """The entry of one key's hash, from an open index file: the head and a few words are read."""
    key = np.array([h], np.uint64)
    head = file.read_at(24 + 8 * 64, 0)
    n, levels, words = np.frombuffer(head, "<i8", 3).tolist()
    if len(head) < 24 + 8 * levels:
        head = file.read_at(24 + 8 * levels, 0)
    ranks, bits, entries = _places(levels, words)
    start = 0
    for level, size in enumerate(np.frombuffer(head, "<i8", levels, 24).tolist()):
        place = int(mixed(key, 100 + level)[0] % np.uint64(size * 64))
        word, bit = start + (place >> 6), place & 63
        first = word // BLOCK * BLOCK
        held = np.frombuffer(file.read_at(8 * (word - first + 1), bits + 8 * first), "<u8")
        if int(held[-1]) >> bit & 1:
            slot = int(np.frombuffer(file.read_at(8, ranks + 8 * (word // BLOCK)), "<i8")[0])
            slot += int(np.bitwise_count(held[:-1]).sum()) + (int(held[-1]) & (1 << bit) - 1).bit_count()
            entry = np.frombuffer(file.read_at(ENTRY.itemsize, entries + ENTRY.itemsize * slot), ENTRY)[0]
            return entry if entry["fingerprint"] == fingerprints(key)[0] else None
        start += size
    return None


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes, 99) >> np.uint64(32)).astype("<u4")


_LOWEST, _NULLS = -(1 << 63), 1 << 40


def _keys(ids, occurrences) -> np.ndarray:
    """Hashes of id and occurrence columns (Arrow)."""
    null = np.array([not x.is_valid for x in ids]) if ids.null_count else np.zeros(len(ids), bool)
    filled = ids.fill_null(_LOWEST).to_numpy(zero_copy_only=False)
    return key_hash(filled, occurrences.to_numpy(zero_copy_only=False) + np.where(null, _NULLS, 0))


def _sort_key(doc_id: int | None, h: int) -> tuple[int, int]:
    return (_LOWEST - 1 if doc_id is None else doc_id, h)  # null: before any long


def bounds_of(sample: list[tuple[int | None, int, int]], shards: int) -> list[tuple[int, int]]:
    """Lower bounds (doc_id, hash) of all shards but the first, of about equal weight, from a sample
    (doc_id, hash, weight). A key that holds several shares is the bound of several."""
    rows = sorted((_sort_key(doc, h), w) for doc, h, w in sample)
    if not rows:
        return []
    upto = np.cumsum([w for _, w in rows], dtype=np.float64)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return [rows[i][0] for i in np.minimum(at, len(rows) - 1).tolist()]


def shard_of(bounds: list[tuple[int, int]], key: tuple[int, int], row: int) -> int:
    """Keys that are several bounds are dealt out among their shards: they are equal in id and text."""
    low, high = bisect_left(bounds, key), bisect_right(bounds, key)
    return high if high - low < 2 else low + 1 + (row * 0x9E3779B97F4A7C15 >> 32) % (high - low)


def _encode(path: str, end_id: int, bounds: list[tuple[int, int]]):
    def run(batches):
        encode = encoder(path)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            for part in slices(batch):
                doc, h, row, text = part.columns
                shard = [shard_of(bounds, _sort_key(d, x), r) for d, x, r in zip(doc.to_pylist(), h.to_pylist(), row.to_pylist())]
                ids = [data + end for data in encode.encode(text.to_pylist())]
                yield pa.record_batch([pa.array(shard, pa.int32()), doc, h, pa.array(ids, pa.binary())], names=["shard", "doc_id", "h", "ids"])

    return run


def _write_shards(folder: str, width: int):
    """Rows (shard, doc_id, h, ids) in order: one file a shard, written a batch at a time."""

    def run(batches):
        file, shard, offset, last, met = None, None, 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), len(held)]
            for a, b in zip(cuts, cuts[1:]):
                if held[a] != shard:
                    if file:
                        file.done()
                    shard, offset, last, met = int(held[a]), 0, None, 0
                    file = Writer(f"{folder}/shard-{shard:06d}.ids")
                doc, ids = batch.column(1).slice(a, b - a), batch.column(3).slice(a, b - a)
                length = np.array(pc.binary_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64) // width
                _, where, data = ids.buffers()
                where = np.frombuffer(where, np.int32, len(ids) + 1, 4 * ids.offset)
                file.write(memoryview(data)[int(where[0]) : int(where[-1])])
                values = doc.fill_null(_LOWEST).to_numpy(zero_copy_only=False)
                null = doc.is_null().to_numpy(zero_copy_only=False)
                new = np.concatenate([[last != (values[0], null[0])], (values[1:] != values[:-1]) | (null[1:] != null[:-1])])
                starts = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                occurrence = np.arange(len(new)) - starts
                if not new[0]:  # the run of an id goes on from the batch before
                    run_end = int(new.argmax()) if new.any() else len(new)
                    occurrence[:run_end] += met
                last, met = (values[-1], null[-1]), int(occurrence[-1]) + 1
                ends = offset + np.cumsum(length)
                yield pa.record_batch([doc, pa.array(occurrence, pa.int64()), pa.array(np.full(len(new), shard, np.int64)), pa.array(ends - length), pa.array(length)], names=["doc_id", "occurrence", "shard", "offset", "length"])
                offset = int(ends[-1])
        if file:
            file.done()

    return run


def _runs(batches, column: str):
    """(value, batch) for each run of one value in a column of sorted batches, runs joined."""
    held, value = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != value:
                yield value, pa.Table.from_batches(held).combine_chunks()
                held = []
            value = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield value, pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str):
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _write_index(folder: str):
    def run(batches):
        for bucket, table in _runs(batches, "bucket"):
            hashes = _keys(_column(table, "doc_id"), _column(table, "occurrence"))
            entries = np.zeros(len(hashes), ENTRY)
            entries["fingerprint"] = fingerprints(hashes)
            for name in ("shard", "offset", "length"):
                entries[name] = _column(table, name).to_numpy(zero_copy_only=False)
            put(f"{folder}/index-{bucket:06d}.mph", index_bytes(hashes, entries))
            yield pa.record_batch([pa.array([bucket], pa.int64()), pa.array([len(hashes)], pa.int64())], names=["bucket", "keys"])

    return run


def _look_up(folder: str):
    def run(batches):
        bucket, index = None, None
        for batch in batches:
            for value, table in _runs(iter([batch]), "bucket"):
                if value != bucket:
                    bucket, index = value, Index(get(f"{folder}/index-{value:06d}.mph"))
                ids, occurrences = _column(table, "doc_id"), _column(table, "occurrence")
                entries, there = index.find(_keys(ids, occurrences))
                yield pa.record_batch([ids, occurrences, *(pa.array(np.where(there, entries[n].astype(np.int64), -1)) for n in ("shard", "offset", "length"))], names=["doc_id", "occurrence", "shard", "offset", "length"])

    return run


def _read(folder: str, width: int):
    """Neighbouring documents of a shard come with one read; a long one in parts."""

    def run(batches):
        dtype, most, file, shard = np.dtype(f"<u{width}"), READ_BYTES // width, None, None
        for batch in batches:
            at, offset, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "offset", "length"))
            crcs, i = np.zeros(len(at), np.int64), 0
            apart = np.append((at[1:] != at[:-1]) | (offset[1:] != offset[:-1] + length[:-1]), True)
            ends = np.flatnonzero(apart)  # the last rows of runs of neighbours
            while i < len(at):
                stop = int(ends[np.searchsorted(ends, i)]) + 1
                first, upto = int(offset[i]), offset[i:stop] + length[i:stop]
                stop = i + max(1, int(np.searchsorted(upto, first + most, "right")))
                if at[i] != shard:
                    fs, name = _fs(f"{folder}/shard-{int(at[i]):06d}.ids")
                    file, shard = fs.open_input_file(name), at[i]
                if length[i] > most:
                    crc, done = 0, 0
                    while done < length[i]:
                        data = np.frombuffer(file.read_at(min(int(length[i]) - done, most) * width, (first + done) * width), dtype)
                        crc, done = zlib.crc32(data.astype("<u4"), crc), done + len(data)
                    crcs[i] = crc
                else:
                    data = memoryview(np.frombuffer(file.read_at(int(upto[stop - i - 1] - first) * width, first * width), dtype).astype("<u4")).cast("B")
                    cuts = (4 * (np.append(first, upto[: stop - i]) - first)).tolist()
                    crcs[i:stop] = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
                i = stop
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "occurrence", "shard", "offset", "length")), pa.array(crcs)], names=["doc_id", "occurrence", "shard", "offset", "length", "ids_crc32"])

    return run


_ROW = "doc_id long, occurrence long, shard long, offset long, length long"


def _sampled(rows: DataFrame, n: int, want: int) -> list[tuple]:
    """About `want` rows by a hash of their places: (doc_id, hash, weight)."""
    weight = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    chosen = rows.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(n)) < want) if want < n else rows
    return list(map(tuple, chosen.select("doc_id", "h", weight).collect()))


def _first_occurrences(sums: list) -> list[tuple[int, int | None, int]]:
    """(shard, doc_id, rows of it in the shards before) where a shard starts with the id that ends the one before."""
    out, last, met = [], None, 0
    for r in sums:
        before = met if last is not None and last == (r["first"],) else 0
        if before:
            out.append((r["shard"], r["first"], before))
        whole = r["last"]["doc_id"] == r["first"]
        last, met = (r["last"]["doc_id"],), r["last"]["occurrence"] + 1 + (before if whole else 0)
    return out


def write_store(docs: DataFrame, end_id: int = 2, path: str | None = None, folder: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encodes docs into a store; its folder, and its keys (doc_id, occurrence, ...). shards: a number
    of shards, by default one for each SHARD_BYTES or so of text and rows."""
    spark = docs.sparkSession
    ship(spark)
    path, folder = path or tokenizer_path(), folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    n = rows.count()
    sample = _sampled(rows, n, SAMPLE) if n else []
    if shards is None:
        size = sum(w for *_, w in sample) / max(1, len(sample)) * n
        shards = max(spark.sparkContext.defaultParallelism, -(-int(size) // SHARD_BYTES))
    if len(sample) < min(n, A_SHARD * shards):
        sample = _sampled(rows, n, A_SHARD * shards)
    width = encoder(path).dtype.itemsize
    encoded = rows.mapInArrow(_encode(path, end_id, bounds_of(sample, shards)), "shard int, doc_id long, h long, ids binary")
    sorted_ = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "h")
    keys = written(sorted_.mapInArrow(_write_shards(folder, width), _ROW), "token-keys")
    summed = keys.groupBy("shard").agg(F.sum("length").alias("ids"), F.count("*").alias("keys"), F.min_by("doc_id", "offset").alias("first"), F.max_by(F.struct("doc_id", "occurrence"), "offset").alias("last"))
    sums = summed.orderBy("shard").collect()  # a row for each shard file
    if further := _first_occurrences(sums):
        more = spark.createDataFrame(further, "_shard long, _id long, _more long")
        same = (F.col("shard") == F.col("_shard")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        keys = keys.join(small(more, len(further), 64), same, "left").select("doc_id", (F.col("occurrence") + F.coalesce("_more", F.lit(0))).alias("occurrence"), "shard", "offset", "length")
    total = sum(r["keys"] for r in sums)
    buckets = max(1, -(-total // BUCKET_KEYS))
    bucketed = keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(buckets)))
    built = bucketed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_write_index(folder), "bucket long, keys long")
    if sum(r["keys"] for r in built.collect()) != total:  # a row for each index file
        raise RuntimeError("the index lacks keys")
    start, listed = 0, []
    for r in sums:
        listed.append({"shard": r["shard"], "start": start, "ids": r["ids"], "keys": r["keys"], "first": r["first"]})
        start += r["ids"]
    put(f"{folder}/shards.json", [json.dumps(listed).encode()])
    put(f"{folder}/manifest.json", [json.dumps({"format": 2, "width": width, "end_id": end_id, "buckets": buckets}).encode()])
    return folder, keys


def read_store(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Looks up keys (doc_id, occurrence) and reads their ids from the files: doc_id, occurrence,
    start, n_tokens, ids_crc32. Keys that aren't in the store are left out."""
    ship(spark)
    meta, shards = json.loads(get(f"{folder}/manifest.json")), json.loads(get(f"{folder}/shards.json"))
    bucket = F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(meta["buckets"]))
    asked = keys.select(F.col("doc_id").cast("long"), F.col("occurrence").cast("long"), bucket.alias("bucket"))
    found = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_look_up(folder), _ROW).where("shard >= 0")
    by_shard = found.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "offset")
    read = by_shard.mapInArrow(_read(folder, meta["width"]), f"{_ROW}, ids_crc32 long")
    starts = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], "shard long, base long")
    return read.join(small(starts, len(shards), 32), "shard").select("doc_id", "occurrence", (F.col("base") + F.col("offset")).alias("start"), F.col("length").alias("n_tokens"), "ids_crc32")


def ids_of(folder: str, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
    """One document's ids by its key, in constant time: the small manifest, a few words and one entry
    of one index file, and the ids are read."""
    import xxhash

    meta = json.loads(get(f"{folder}/manifest.json"))
    h = 42  # Spark's xxhash64 chains its columns; a null leaves the hash as it is
    for x in (doc_id, occurrence):
        h = h if x is None else xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
    bucket = (h - (1 << 64) if h >> 63 else h) % meta["buckets"]
    key = _keys(pa.array([doc_id], pa.int64()), pa.array([occurrence], pa.int64()))
    fs, name = _fs(f"{folder}/index-{bucket:06d}.mph")
    if fs.get_file_info(name).type == FileType.NotFound:
        return None
    with fs.open_input_file(name) as f:
        entry = find_one(f, int(key[0]))
    if entry is None:
        return None
    fs, name = _fs(f"{folder}/shard-{int(entry['shard']):06d}.ids")
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read_at(int(entry["length"]) * meta["width"], int(entry["offset"]) * meta["width"]), f"<u{meta['width']}")
