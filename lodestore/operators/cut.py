"""Cutting plans where a result is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import StorageError


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one where it is unset and all
    runs on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise StorageError("spark.checkpoint.dir isn't set: driver and executors need a shared folder")
        context.setCheckpointDir(given or tempfile.mkdtemp())
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df in the checkpoint folder that driver and executors share: it is computed once, survives lost
    executors, and later plans start from it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in that folder, which is smaller than cut() for many or wide rows, and of which
    later plans read the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
