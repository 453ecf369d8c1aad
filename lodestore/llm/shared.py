"""What the operators of this subpackage share: durable tables in the cluster's shared
folder, broadcasts behind a size check, and gapless numbering without one big task."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows, counted beforehand, need no more than this.
BROADCAST_BYTES = 32 << 20
BLOCK_ROWS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset and all runs on one machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestore-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. Cuts the lineage: what is computed from it
    after an executor is lost starts from these files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, at a task's end: idle workers stay
    for the next task, beside the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def fits(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows fit the limit; else df, and Spark shuffles."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


def join_in_place(rows: DataFrame, side: DataFrame, row: str, key: str, n: int, row_bytes: int, how: str, name: str) -> DataFrame:
    """rows join side on row = key, where rows (written, row from monotonically_increasing_id, so
    that a file holds a run of it) may carry whole texts and never move. side's n rows are broadcast;
    where they are too many for that, in slices: each is a range of row that has as many rows of side
    as may be broadcast (counted by blocks of BLOCK_ROWS; the counts come to the driver), reads that
    range of rows only, and is written. Each row of rows is read once either way."""
    if fits(n, row_bytes):
        return rows.join(F.broadcast(side), F.col(row) == F.col(key), how)
    block = F.shiftright(F.col(key), BLOCK_ROWS.bit_length() - 1)
    cuts, held = [], 0
    for at, found in side.groupBy(block.alias("block")).count().orderBy("block").collect():
        if held and not fits(held + found, row_bytes):
            cuts.append(at * BLOCK_ROWS)
            held = 0
        held += found
    path = new_folder(rows.sparkSession, name)
    schema = None
    for a, b in zip([None, *cuts], [*cuts, None]):
        def inside(c: str) -> Column:
            return (F.lit(True) if a is None else F.col(c) >= a) & (F.lit(True) if b is None else F.col(c) < b)

        part = rows.where(inside(row)).join(F.broadcast(side.where(inside(key))), F.col(row) == F.col(key), how)
        schema = part.schema
        part.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def packed_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of docs as one column _doc, beside own columns: names in docs can't clash with those.
    select("_doc.*") gives the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[c.alias(name) for name, c in columns.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same, and faster, where all bytes are ASCII."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_in(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t to \\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def join_on_groups(rows: DataFrame, groups: DataFrame, key: str, heavy_rows: int, heavy_at: int, count: str) -> DataFrame:
    """rows (inner) join groups on key, where a few keys may hold much of rows. Groups of at
    least heavy_at rows are at most len(rows)/heavy_at; that side is broadcast, so their rows
    stay where they are. The rest is shuffled by key. heavy_rows: the number of heavy groups."""
    if not heavy_rows:
        return rows.join(groups, key)
    heavy, light = groups.where(F.col(count) >= heavy_at), groups.where(F.col(count) < heavy_at)
    few = small(heavy, heavy_rows, 256)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(light, key))


def blocks_for(rows: int, least: int = 2000) -> int:
    """Blocks for running(): about as many rows in a block as there are blocks, so that neither a
    block nor the list of blocks is large."""
    return max(1, -(-rows // max(least, isqrt(rows))))


def running(df: DataFrame, group: list[str], block: Column, order: list[Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """Adds out: the sum of value over all earlier rows of the group. Rows are ordered by block,
    then order. No task holds more than a block of a group and the list of a group's blocks, so
    a group of any size is dealt over many tasks. total: adds the group's sum too.
    df must give the same rows whenever it is read (a written table)."""
    df = df.withColumn("_block", block).withColumn("_value", value)
    sums = df.groupBy(*group, "_block").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if total:
        sums = sums.withColumn(total, F.sum("_sum").over(W.partitionBy(*group)))
    renamed = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"), "_before", *([total] if total else []))
    inside = W.partitionBy(*group, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_block") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    df = df.join(renamed, same).withColumn(out, F.col("_before") + F.col("_inside"))
    return df.drop("_block", "_value", "_before", "_inside", "_b", *[f"_g{i}" for i in range(len(group))])
