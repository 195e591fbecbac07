"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go in order of size, largest first, to the least-loaded shard through a
heap.  Billions of groups do not fit a driver, so what it schedules are size classes: how many groups there are of a size
and how many bytes they hold.  Sizes below 1,024 are classes of their own, larger ones are told apart by their ten leading
bits (to within 1/512), so there are at most 512 classes for each doubling of the size and never more than 28,000.  Inside a class groups count alike, and a class's groups are dealt out exactly as the heap would deal them one
after the other: each goes to the shard that is least loaded then.  The result is a count for each class and shard; a
group's place in its class then says which shard it goes to.  A group larger than a shard's fair share fills its shard by
itself, since it may not be split.

Defined results: a null text counts as empty (0 bytes plus the fixed 16) and belongs with empty texts; rows that
repeat, or have no id, each get a slot; ties go to the smaller shard; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm._batches import saved, two
from shelfspark.llm.skew import ranked, salted

LEADING = 10


def size_class(size: Column) -> Column:
    """The size with all but its leading bits set to zero."""
    spare = F.greatest(F.ceil(F.log2(size + F.lit(1.0))).cast("int") - LEADING, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, spare), spare)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """Longest processing time first over classes ``class, groups, bytes``: for each the shards in turn and how many groups each got.

    Returns ``class, upto``, where ``upto[s]`` is how many of the class's groups have gone to shards 0 to s.
    """
    load, out = [0.0] * shards, []
    for name, groups, size in sorted(classes, reverse=True):
        each, got = size / groups, [0] * shards
        left = groups
        if groups > 4 * shards:
            # all that the heap would do below the level that every shard reaches: whole rounds at once
            level = _level(load, each, groups - shards)
            got = [max(0, int((level - x) // each)) for x in load]
            left -= sum(got)
        heap = [(x + n * each, s) for s, (x, n) in enumerate(zip(load, got, strict=True))]
        heapq.heapify(heap)
        for _ in range(left):
            x, s = heap[0]
            got[s] += 1
            heapq.heapreplace(heap, (x + each, s))
        load = [x + n * each for x, n in zip(load, got, strict=True)]
        upto, total = [], 0
        for n in got:
            total += n
            upto.append(total)
        out.append((name, upto))
    return out


def _level(load: list[float], each: float, groups: int) -> float:
    """The level to which ``groups`` of equal size fill the least-loaded shards, as if they could be divided."""
    order, below = sorted(load), 0.0
    for k, x in enumerate(order, 1):
        below += x
        level = (below + groups * each) / k
        if k == len(order) or level <= order[k]:
            return level
    raise AssertionError


def assign(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_slot_block: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = saved(two(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("row")))
    blocks = max(1, -(-narrow.count() // rows_per_slot_block))
    groups = saved(narrow.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes"))))
    classes = [(r["class"], r["n"], r["bytes"]) for r in groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()]  # at most 28,000
    upto = spark.createDataFrame(schedule(classes, shards), "class long, upto array<long>")
    placed = ranked(groups.select("key", "class"), "class", ["key"], "place", blocks)
    # the first shard up to which more groups went than come before this one; one row a class
    shard = F.size(F.filter("upto", lambda n: n <= F.col("place")))
    of_group = saved(placed.join(F.broadcast(upto), "class").select("key", shard.alias("shard")))
    out = saved(salted(narrow, of_group, ["key"]).drop("key"))
    out = ranked(out, "shard", ["row"], "slot", blocks)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
