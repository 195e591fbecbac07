"""Numbers inside a group: free ones, gaps, and a new place for members that lose theirs.

Nothing is counted up to the largest number: free numbers follow from the sorted taken ones, since before the m-th taken number
t there are t - m free ones.  Groups of any size are walked in ranges of (group, order) with sums of the ranges before, so a
group that holds most of the rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.clusters import written


def prefix(rows: DataFrame, group: str, order: list[str], **running: tuple[str, Column]) -> DataFrame:
    """``rows`` with running values inside each group, own row included: ``name=("sum" or "max", column)``.

    Rows that tie in ``order`` may come in any order; give keys that don't tie.
    """
    ranged = written(rows.withColumns({f"_{k}": c for k, (_, c) in running.items()}).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, *order).withColumn("_range", F.spark_partition_id()))
    of = {"sum": F.sum, "max": F.max}
    totals = ranged.groupBy(group, "_range").agg(*(of[kind](f"_{k}").alias(f"_t_{k}") for k, (kind, _) in running.items()))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(group, "_range", *(of[kind](f"_t_{k}").over(before).alias(f"_b_{k}") for k, (kind, _) in running.items()))
    inside = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(totals, [group, "_range"])
    own = {k: of[kind](f"_{k}").over(inside) for k, (kind, _) in running.items()}
    both = {k: F.coalesce(own[k] + F.col(f"_b_{k}"), own[k], F.col(f"_b_{k}")) if kind == "sum" else F.greatest(own[k], F.col(f"_b_{k}")) for k, (kind, _) in running.items()}
    return out.withColumns(both).drop("_range", *(f"_{k}" for k in running), *(f"_b_{k}" for k in running))


def taken_ranks(taken: DataFrame, group: str, number: str) -> DataFrame:
    """``group, t, m``: the distinct positive numbers of each group and their places from 1."""
    distinct = taken.where(F.col(number) >= 1).select(group, F.col(number).cast("long").alias("t")).distinct()
    return prefix(distinct, group, ["t"], m=("sum", F.lit(1).cast("long")))


def next_free(taken: DataFrame, group: str, number: str) -> DataFrame:
    """``group, free``: the least positive number that a group has not taken; 1 for a group with none."""
    ranks = taken_ranks(taken, group, number)
    first = ranks.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("t") != F.col("m"), F.col("m"))), F.max("m") + 1).alias("free"))
    return taken.select(group).distinct().join(first, group, "left").select(group, F.coalesce("free", F.lit(1).cast("long")).alias("free"))


def gaps(taken: DataFrame, group: str, number: str, totals: DataFrame | None = None, total: str = "total") -> DataFrame:
    """``group, first, last``: the runs of numbers that are missing before the largest, or up to a declared total."""
    marks = taken.where(F.col(number) >= 1).select(group, F.col(number).cast("long").alias("t"))
    if totals is not None:  # a declared total counts where it goes beyond what is there
        most = marks.groupBy(group).agg(F.max("t").alias("_most"))
        beyond = totals.join(most, group, "left").where(F.col(total) > F.coalesce("_most", F.lit(0)))
        marks = marks.unionByName(beyond.select(group, (F.col(total).cast("long") + 1).alias("t")))
    distinct = marks.distinct()
    # each number is told the one before it: t leaves itself at t + 1 for whatever comes next
    both = distinct.withColumn("k", F.lit(1)).unionByName(distinct.select(group, (F.col("t") + 1).alias("t"), F.lit(0).alias("k")))
    told = prefix(both, group, ["t", "k"], seen=("max", F.when(F.col("k") == 0, F.col("t") - 1))).where("k = 1")
    return told.select(group, (F.coalesce("seen", F.lit(0)) + 1).alias("first"), (F.col("t") - 1).alias("last")).where("first <= last")


def placed(members: DataFrame, group: str, number: str, auto: str, id_col: str = "_id") -> DataFrame:
    """``id, group, number, moved``: members with a number of their own each.

    Editorial numbers (``auto`` not true) stay as they are, even if two are equal: the catalogue only knows what is printed.  A
    number that an editorial member has, or that an automatic member of a smaller id has, is lost to the other automatic ones; each goes to
    the next free number above it, in order of number and id.  Members without a number are not touched.
    """
    rows = members.select(F.col(id_col).alias("_id"), F.col(group).alias("_g"), F.col(number).cast("long").alias("n"), F.coalesce(F.col(auto), F.lit(False)).alias("_auto"))
    numbered = rows.where("n is not null and n >= 1 and _g is not null")
    claim = numbered.groupBy("_g", "n").agg(F.max(~F.col("_auto")).alias("_editorial"), F.min(F.when(F.col("_auto"), F.col("_id"))).alias("_first"))
    judged = written(numbered.join(claim, ["_g", "n"]).withColumn("_stays", ~F.col("_auto") | (~F.col("_editorial") & (F.col("_id") == F.col("_first")))).select("_id", "_g", "n", "_stays"))
    ranks = written(taken_ranks(judged.where("_stays").withColumnRenamed("_g", "g"), "g", "n"))
    lost = judged.where("not _stays").select(F.col("_g").alias("g"), "n", "_id")
    # how many free numbers are up to each lost one: the taken ranks before it, by one walk over both
    both = ranks.select("g", F.col("t").alias("at"), F.lit(0).alias("k"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), "m").unionByName(lost.select("g", F.col("n").alias("at"), F.lit(1).alias("k"), "_id", F.lit(None).cast("long").alias("m")))
    walked = prefix(both, "g", ["at", "k", "_id"], taken=("max", F.coalesce("m", F.lit(0).cast("long"))), i=("sum", F.col("k").cast("long"))).where("k = 1")
    # the i-th lost member takes free number max over earlier j of (free up to its own number + 1 - j), plus i
    wanted = walked.select("g", "_id", "i", "at", (F.col("at") - F.col("taken") + 1 - F.col("i")).alias("_w"))
    chosen = prefix(wanted, "g", ["i"], q=("max", F.col("_w"))).select("g", "_id", (F.col("q") + F.col("i")).alias("q"))
    # the q-th free number is q plus the taken t whose t - m is below q
    both = ranks.select("g", (F.col("t") - F.col("m")).alias("at"), F.lit(1).alias("k"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"), "m").unionByName(chosen.select("g", F.col("q").alias("at"), F.lit(0).alias("k"), "_id", F.lit(None).cast("long").alias("m")))
    counted = prefix(both, "g", ["at", "k", "m", "_id"], below=("max", F.coalesce("m", F.lit(0).cast("long")))).where("k = 0")
    moved = counted.select("_id", F.col("g").alias("_g"), (F.col("at") + F.col("below")).alias("_to"))
    out = rows.join(moved, ["_id", "_g"], "left")
    return out.select("_id", F.col("_g").alias(group), F.coalesce("_to", "n").alias(number), F.col("_to").isNotNull().alias("moved"))


def union_by(a: Column, b: Column, key: str) -> Column:
    """Structs of ``a``, then those of ``b`` whose ``key`` is new; the first of each key stays, structs without one are left out."""
    both = F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
    keys = F.transform(both, lambda x: x[key])
    return F.filter(both, lambda x, i: x[key].isNotNull() & (F.array_position(keys, x[key]) == i + 1))
