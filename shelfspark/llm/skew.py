"""Joins and ranks that no hot key puts into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot from more than this share of all rows on, so there are fewer hot keys than this number.
SHARE = 1024


def hot(rows: DataFrame, keys: list[str], share: int = SHARE) -> DataFrame:
    """``keys, _parts`` of the keys that more than 1/``share`` of all rows have; each part then has at most that many.

    Fewer than ``share`` rows whatever the input, so they may be broadcast.  ``rows`` should be a written table.
    """
    total = rows.count()
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * share > total)
    return counts.select(*keys, F.ceil(F.col("_n") * share / max(total, 1)).cast("int").alias("_parts"))


def salted(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", share: int = SHARE, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``unique``, one row a key: a hot key's rows are dealt over parts, each of which gets a copy of its row.

    The hot keys, fewer than ``share``, come to the driver and back as literals, so that no other key pays for them.  Null
    keys are no keys: an inner join leaves their rows out, a left join keeps them without a match.  ``counted`` has the
    same keys as ``rows`` if that isn't a written table.  ``unique`` grows with the input, so it is never broadcast: Spark
    judges a table by its compressed size, and several such tables at once don't fit the driver.
    """
    (key,) = keys
    unique = unique.hint("merge")
    found = hot((rows if counted is None else counted).select(key).dropna(), keys, share).collect()
    if not found:
        return rows.join(unique, keys, how)
    parts = max(r["_parts"] for r in found)
    is_hot = F.coalesce(F.col(key).isin([r[key] for r in found]), F.lit(False))
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(0))
    right = unique.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).hint("merge")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def ranked(rows: DataFrame, group: str, order: list[str], name: str, blocks: int) -> DataFrame:
    """``rows`` with their place in ``group``, gapless from 0, as ``name``.

    Rows are ranked inside blocks of a hash of ``order`` and numbered on from the blocks before, so no group is sorted in
    one task.
    """
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit(5)), F.lit(blocks)).cast("int"))
    counts = rows.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)))
    place: Column = (F.col("_before") + F.col("_rank") - 1).cast("long")
    return inside.join(counts, [group, "_block"]).withColumn(name, place).drop("_block", "_before", "_rank")
