"""The inbox: files seen as a stream, outcomes, dead letters; when files and folders are whole is in ``states``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.classification import file_format


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, root: str, per_batch: int = 50) -> DataFrame:
    """New files below ``root`` as a stream, a bounded number a micro-batch."""
    files = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return files.select(F.col("path").alias("ruta"), file_format(F.col("path")).alias("formato"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))


def routed(files: DataFrame, archived: DataFrame) -> DataFrame:
    """Files with their ``outcome``: empty ones unreadable, known content duplicate, unknown formats quarantined, the rest new."""
    known = archived.select("hash", F.lit(True).alias("_known")).distinct()
    rows = files.join(known, "hash", "left")
    outcome = F.when(F.col("bytes") == 0, "ilegible").when(F.col("_known"), "duplicado").when(F.col("formato").isin("otro", "desconocido"), "cuarentena").otherwise("nuevo")
    return rows.withColumn("outcome", outcome).drop("_known")


def split_outcomes(batch: DataFrame, root: str, epoch: int) -> None:
    """For ``foreachBatch``: each outcome below its own folder; a repeated batch overwrites itself."""
    batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{root}/epoch={epoch}")


def mixed_folders(files: DataFrame) -> DataFrame:
    """Folders with two document children or more and an audio child: a child's kind is that of most of its files."""
    child = files.groupBy("padre", "carpeta").agg((F.count_if(F.col("formato") == "audio") * 2 > F.count("*")).alias("audio"))
    return child.groupBy("padre").agg(F.count_if(~F.col("audio")).alias("d"), F.count_if("audio").alias("a")).where("d >= 2 and a >= 1").select("padre")
