"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to Python workers, once for each Spark context, so that functions of it run
    there however the driver was started. Spark serves the file; executors need no shared folder."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_lodestore_shipped", False) or not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="lodestore-")) / "lodestore.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._lodestore_shipped = True
