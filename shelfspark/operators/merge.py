"""Conservative merging, upserts, identity, differences, guarded deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.model import absent


def merge_records(base: DataFrame, incoming: DataFrame, key: str, *, fill: list[str], upgrade: list[str] = (), union: list[str] = ()) -> DataFrame:
    """Fill gaps; overwrite ``upgrade`` columns of pending, unlocked rows; unite arrays; insert new rows.

    A value once there is never replaced by an absent one.
    """
    new = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in (*fill, *upgrade, *union)))
    rows = base.join(new, key, "full")
    there = lambda c: F.when(~absent(F.col(c).cast("string")), F.col(c))
    free = F.coalesce(F.col("pending"), F.lit(False)) & ~F.coalesce(F.col("locked"), F.lit(False))
    out = {c: F.coalesce(there(c), F.col(f"_{c}")) for c in fill}
    out |= {c: F.when(free, F.coalesce(there(f"_{c}"), F.col(c))).otherwise(F.coalesce(there(c), F.col(f"_{c}"))) for c in upgrade}
    empty = lambda c: F.coalesce(F.col(c), F.array())
    out |= {c: F.array_union(empty(c), empty(f"_{c}")) for c in union}
    return rows.withColumns(out).drop(*(f"_{c}" for c in (*fill, *upgrade, *union)))


def upsert_count(old: DataFrame, used: DataFrame, key: str, count: str) -> DataFrame:
    """A counter raised by each use; new keys begin with theirs."""
    n = used.groupBy(key).agg(F.count("*").alias("_n"))
    return old.join(n, key, "full").select(key, (F.coalesce(count, F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias(count))


def set_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def add_to_set(rows: DataFrame, column: str, values: list) -> DataFrame:
    return rows.withColumn(column, F.array_union(F.coalesce(column, F.array()), F.array(*map(F.lit, values))))


def pull(rows: DataFrame, column: str, values: list) -> DataFrame:
    return rows.withColumn(column, F.filter(column, lambda x: ~x.isin(*values)))


def delete_unreferenced(rows: DataFrame, key: str, references: DataFrame, by: str) -> DataFrame:
    """Without the rows that nothing refers to."""
    return rows.join(references.select(F.col(by).alias(key)).distinct(), key, "left_semi")


def unique_or_flagged(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of a key keeps it; the others lose it and are marked for review."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("_r", F.when(F.col(key).isNotNull(), rank))
    return rows.withColumns({key: F.when(F.coalesce("_r", F.lit(1)) == 1, F.col(key)), "revision_requerida": F.coalesce(F.col("_r") > 1, F.lit(False))}).drop("_r")


def unexpired(rows: DataFrame, at: str, now: Column, ttl: str) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"interval {ttl}"))


def differences(base: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, field, current, incoming`` where trimmed lower-case values differ and something comes in."""
    rows = base.select(key, *columns).join(incoming.select(key, *(F.col(c).alias(f"_{c}") for c in columns)), key)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("current"), F.col(f"_{c}").cast("string").alias("incoming")) for c in columns))
    flat = rows.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    same = F.lower(F.trim("current")).eqNullSafe(F.lower(F.trim("incoming")))
    return flat.where(~absent(F.col("incoming")) & ~same)


def remapped(rows: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """An array of keys with merged ones replaced (``old`` to ``new``) and repeats dropped, in order."""
    flat = rows.select("_id", F.posexplode_outer(column).alias("pos", "old")).join(remap, "old", "left")
    got = flat.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "old").alias("k")))).alias("x"))
    return rows.drop(column).join(got.select("_id", F.array_distinct(F.filter(F.col("x.k"), lambda k: k.isNotNull())).alias(column)), "_id")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
