"""Helpers for Arrow batches of texts and for cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

import shelfspark

#: Texts are worked on in runs of about this many bytes, so that memory stays bounded.
RUN_BYTES = 2 << 20


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each run holds about ``budget`` bytes of text (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // budget
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, with each text's start and end; null counts as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    return data, bounds[:-1], bounds[1:]


def strings(texts: pa.Array) -> list[str]:
    return pc.fill_null(texts, "").to_pylist()


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that all machines share; only a local session without one gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="shelfspark-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder that the executors share and go on from the written rows."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    tables(spark).append(path)
    return out


def tables(spark: SparkSession) -> list[str]:
    """The paths of the tables that :func:`saved` wrote in this session and that still exist."""
    context = spark.sparkContext
    if not hasattr(context, "_shelfspark_tables"):
        context._shelfspark_tables = []
    return context._shelfspark_tables


def dropped(df: DataFrame) -> None:
    """Delete a table that :func:`saved` wrote and that nothing reads any more."""
    _delete(df.sparkSession, df._saved_at)


def swept(df: DataFrame, before: list[str]) -> DataFrame:
    """Delete all tables written since ``before`` (a copy of :func:`tables`) but ``df``, which no longer needs them."""
    for path in [p for p in tables(df.sparkSession) if p not in before and p != df._saved_at]:
        _delete(df.sparkSession, path)
    return df


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if at in tables(spark):
        tables(spark).remove(at)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark context, in case it isn't installed there."""
    context = spark.sparkContext
    if getattr(context, "_shelfspark_shipped", False):
        return
    top = Path(shelfspark.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="shelfspark-"), "shelfspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(path)
    context._shelfspark_shipped = True


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, so that other columns never clash.

    Ids are whole numbers; a text that is none stops the job instead of becoming null.
    """
    ship(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
