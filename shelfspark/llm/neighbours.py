"""The next row in a global order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm._batches import saved


def with_next(rows: DataFrame, key: str, *, wrap: bool = True) -> DataFrame:
    """``rows`` with ``next_key``, the next larger value of the distinct column ``key`` (after the last: the first).

    Rows are dealt out by ranges of the key and the ranges written down, so that every later step sees the same ones.
    Inside a range a window finds the next; a range's last row takes the first key of the next range, which comes from
    one row a range.
    """
    spark = rows.sparkSession
    ranged = saved(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy("_range").agg(F.min(key).alias("_first"))
    order = Window.orderBy("_range")
    of_range = firsts.select("_range", F.lead("_first").over(order).alias("_after"), F.min("_first").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_least"))
    inside = ranged.withColumn("_next", F.lead(key).over(Window.partitionBy("_range").orderBy(key)))
    following = F.coalesce("_next", "_after", *(["_least"] if wrap else []))
    # one row for each range, so at most as many as there are shuffle partitions
    return inside.join(F.broadcast(of_range), "_range").select(*rows.columns, following.alias("next_key"))
