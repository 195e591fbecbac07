"""Connected components by alternating star rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all machines share; only a local session without one gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="shelfspark-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, which ends its lineage."""
    path = f"{shared_folder(df.sparkSession)}/links-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chained(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """Links ``u, v`` that connect rows of equal keys: each to the least of its key, so as many as there are rows."""
    least = rows.groupBy(*keys).agg(F.min(node).alias("u"))
    return rows.join(least, keys).select("u", F.col(node).alias("v")).where("u <> v")


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node, root being the smallest in reach."""
    edges = written(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = None
    while seen != (now := tuple(state(edges))) and now[0]:
        seen = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a <> b")
        edges = written(moved.unionAll(low.select(F.col("m").alias("a"), F.col("v").alias("b"))).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def vetoed(members: DataFrame, root: str, key: str) -> DataFrame:
    """Members of clusters that hold at most one distinct value of ``key``."""
    bad = members.where(F.col(key).isNotNull()).groupBy(root).agg(F.count_distinct(key).alias("n")).where("n > 1")
    return members.join(bad.select(root), root, "left_anti")


def canonical(members: DataFrame, root: str, order: list) -> DataFrame:
    """The first member of each cluster in the given order."""
    return members.withColumn("_r", F.row_number().over(Window.partitionBy(root).orderBy(*order))).where("_r = 1").drop("_r")
