"""Gives executors this package, in case it isn't installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    """Send the package's code once for each Spark context; the archive is code, no data."""
    context = spark.sparkContext
    if getattr(context, "_shelfspark_shipped", False):
        return
    top = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="shelfspark-"), "shelfspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(path)
    context._shelfspark_shipped = True
