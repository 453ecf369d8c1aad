"""Exact dedup with two-pass Bloom filtering, in DataFrame functions only.

Pass 1 builds a blocked Bloom filter: a text's hash chooses one 64-bit word and K bits in it. For
each word the bits that two rows or more have set are kept (rows of the same word and bits are
counted first, map-side, so copies of a text are one entry). Pass 2 probes it: a text whose K bits
aren't all there occurs once, for sure, and its row passes straight through. Only the others are
shuffled by their full SHA-256, which decides. The filter has BITS_PER_ROW bits a row, so that about
2 in 100 single texts are shuffled for nothing. It is broadcast if its counted words fit the limit;
beyond it rows of hashes (id, hash, row number) meet it by a shuffle, where words of many rows are
broadcast still. Texts are never shuffled: kept_rows writes the rows with a number and leaves out, in
place, those that go.

Defined results: a null text counts as empty, and empty texts are equal to each other. Of rows
that repeat both doc_id and text one stays. A null doc_id is lower than any other. An empty
table gives an empty result. Columns beside doc_id and text are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fits, join_in_place, join_on_groups, packed_rows, written

BITS_PER_ROW, K, WORD_BYTES = 16, 2, 64
HEAVY_PARTS = 10_000


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _place(words: int) -> tuple[Column, Column]:
    """The word of a hash in the filter, and its bits there."""
    bits = F.xxhash64(F.lit(1), "_sha")
    shifts = [F.shiftright(bits, 6 * i).bitwiseAND(63).cast("int") for i in range(K)]
    mask = F.lit(0).cast("long")
    for s in shifts:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s))
    return F.pmod(F.xxhash64(F.lit(0), "_sha"), F.lit(words).cast("long")), mask


def _several(found: Column) -> Column:
    """Of (mask, n) entries of a word: the bits that are set by two rows or more."""

    def add(seen: Column, x: Column) -> Column:
        twice = seen["twice"].bitwiseOR(F.when(x["n"] > 1, x["_mask"]).otherwise(seen["once"].bitwiseAND(x["_mask"])))
        return F.struct(seen["once"].bitwiseOR(x["_mask"]).alias("once"), twice.alias("twice"))

    none = F.lit(0).cast("long")
    return F.aggregate(found, F.struct(none.alias("once"), none.alias("twice")), add, lambda seen: seen["twice"])


def repeated_bits(hashed: DataFrame, rows: int) -> DataFrame:
    """Pass 1 over hashed (_sha, _word, _mask): the words (_word, _bits, _n) that have bits set by
    two rows or more; _n is the word's number of rows."""
    masks = hashed.groupBy("_word", "_mask").agg(F.count("*").alias("n"))
    words = masks.groupBy("_word").agg(F.collect_list(F.struct("_mask", "n")).alias("_found"), F.sum("n").alias("_n"))  # at most 64 + 64 * 63 / 2 entries
    words = words.select("_word", _several(F.col("_found")).alias("_bits"), "_n")
    return written(words.where("_bits <> 0"), "repeated-bits")


def probe(hashed: DataFrame, bits: DataFrame, rows: int) -> DataFrame:
    """Pass 2: hashed with _maybe, false only where no other row has this _sha."""
    words = bits.count()
    if fits(words, WORD_BYTES):
        joined = hashed.join(F.broadcast(bits.drop("_n")), "_word", "left")
    else:
        heavy_at = max(1000, rows // HEAVY_PARTS)
        heavy = F.broadcast(bits.where(F.col("_n") >= heavy_at).select(F.col("_word").alias("_w"), F.col("_bits").alias("_heavy")))  # at most HEAVY_PARTS
        first = hashed.join(heavy, F.col("_word") == F.col("_w"), "left").drop("_w")
        rest = first.where("_heavy IS NULL").drop("_heavy").join(bits.where(F.col("_n") < heavy_at).drop("_n"), "_word", "left")
        joined = rest.unionByName(first.where("_heavy IS NOT NULL").withColumnRenamed("_heavy", "_bits"))
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return joined.withColumn("_maybe", maybe).drop("_word", "_mask", "_bits")


def decisions(hashed: DataFrame) -> DataFrame:
    """One row for each row of hashed (written: doc_id, _sha, _row): doc_id, _sha, _row, keep_id, group_size, kept."""
    rows = hashed.count()
    word, mask = _place(max(1, rows * BITS_PER_ROW // 64))
    placed = hashed.select("doc_id", "_sha", "_row", word.alias("_word"), mask.alias("_mask"))
    table = written(probe(placed, repeated_bits(placed, rows), rows), "probed")
    once = table.where("NOT _maybe").select("doc_id", "_sha", "_row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = table.where("_maybe").drop("_maybe")
    groups = again.groupBy("_sha").agg(F.max(F.struct("doc_id", "_row")).alias("_last"), F.count("*").alias("group_size"))
    groups = written(groups, "groups")
    heavy_at = max(1000, rows // HEAVY_PARTS)
    heavy = groups.where(F.col("group_size") >= heavy_at).count()  # at most HEAVY_PARTS
    joined = join_on_groups(again, groups, "_sha", heavy, heavy_at, "group_size")
    joined = joined.select("doc_id", "_sha", "_row", F.col("_last.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_last._row")).alias("kept"))
    return once.unionByName(joined)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    hashed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), digest(F.col(f"`{text_col}`")).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    found = decisions(written(hashed, "hashed"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are numbered and hashed as they are
    written once; only hashes of possibly repeated ones are shuffled."""
    rows = written(packed_rows(docs, doc_id=F.col(f"`{id_col}`").cast("long"), _sha=digest(F.col(f"`{text_col}`")), _row=F.monotonically_increasing_id()), "keyed")
    gone = written(decisions(rows.select("doc_id", "_sha", "_row")).where("NOT kept").select(F.col("_row").alias("_gone")), "gone")
    return join_in_place(rows, gone, "_row", "_gone", gone.count(), 64, "left_anti", "kept").select("_doc.*")
