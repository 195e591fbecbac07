"""Audit of how filters interact: what each filter of an order removes, alone, again, and over all orders.

Duplicates are found by sorting: rows are dealt out by ranges of (digest of the text, id), sorted inside each range by
digest, whole text and id, and each row is compared with its predecessor.  A run of equal texts may go over the border of
ranges; the digests that stand first or last in a range (two a range) are therefore looked up in all ranges.  Ranges hold
ids too, so that a text with a third of all rows is dealt over many tasks.

A row then is a mask of the filters that it fails.  Masks are counted by part and label, which adds up over any split of the
rows, and every order and step is a sum over at most 32 masks.

Defined results: a null text counts as empty (no words, no characters) and is a duplicate of any other empty one; rows that
repeat an id are not each other's duplicates, since neither id is smaller; a row without an id neither is nor has a
duplicate, and has no label; of several labels of an id any one with the value counts; a null part is the empty string; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm._batches import runs, saved, ship

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_CAPITALS = bytes(range(65, 91))
_SIGNS = re.compile(rb"[#$%&*|]")
_NO_ID = np.iinfo(np.int64).max


def text_mask(text: str, *, least_words: int = 200, variety: int = 50, capitals: int = 2) -> int:
    """Bits of the filters A to D that a text fails: too short, too repetitive, too many capitals, markup signs."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at the six ASCII blanks only
    mask = BIT["A"] * (len(words) < least_words) | BIT["B"] * (100 * len(set(words)) < variety * len(words))
    mask |= BIT["C"] * (100 * (len(data) - len(data.translate(None, _CAPITALS))) > capitals * len(text))
    return mask | BIT["D"] * (_SIGNS.search(data) is not None)


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", ranges: int | None = None) -> DataFrame:
    """``doc_id, part, mask``: one row a row of ``docs``, with all the filters that it fails."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), "digest", "doc_id").sortWithinPartitions("digest", "text", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, _NO_ID  # the predecessor's text and the smallest id of its run
        for batch in runs(batches):
            texts = batch.column("text")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
            new[0] = before is None or texts[0].as_py() != before
            ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
            least = np.minimum.reduceat(ids, starts)
            if not new[0]:
                least[0] = min(least[0], first)
            own = np.repeat(least, np.diff([*starts, batch.num_rows]))
            heads = [text_mask(texts[int(i)].as_py()) for i in starts]  # equal texts have one mask
            masks = np.repeat(np.array(heads, np.int32), np.diff([*starts, batch.num_rows]))
            before, first = texts[batch.num_rows - 1].as_py(), least[-1]
            at = np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(masks), pa.array(own), pa.array(at)], ["doc_id", "part", "digest", "mask", "first", "at"])

    narrow = saved(dealt.mapInArrow(work, "doc_id long, part string, digest binary, mask int, first long, at int"))
    ends = narrow.groupBy("at").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    # two rows a range at most, so it may be broadcast
    least = narrow.join(F.broadcast(ends), "digest").groupBy("digest").agg(F.min("first").alias("_least"))
    rows = narrow.join(F.broadcast(least), "digest", "left")
    again = F.coalesce(F.col("doc_id") > F.least("first", "_least"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + F.when(again, BIT["E"]).otherwise(0)).alias("mask"))


def counted(failed: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: additive counters of the rows of ``failed`` with each mask, and of those with a label."""
    flag = lambda c, value: F.max(F.coalesce(labels[c] == value, F.lit(False)))
    known = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("doc_id")).agg(flag("quality", 1).alias("good"), flag("toxic", 1).alias("toxic"))
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))  # so a hot id is one row a part and mask
    with_label = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), with_label("good").alias("good"), with_label("toxic").alias("toxic"))


def every_step() -> list[tuple[str, int, int, int]]:
    """``filter_order, step, prior, own``: all orders and steps, with the bits of the earlier filters and of the step's own."""
    out = []
    for order in permutations(FILTERS):
        prior = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(order), step, prior, BIT[f]))
            prior |= BIT[f]
    return out


def interactions(counters: DataFrame) -> DataFrame:
    """One row a part, order and step: what is kept, removed, redundant, unique, lost, and the Shapley sum."""
    steps = every_step()
    pairs = sorted({(prior, own) for *_, prior, own in steps})
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("prior"), F.lit(o).alias("own")) for p, o in pairs))).alias("s")
    rows = counters.select("part", "mask", "n", "good", "toxic", each).select("part", "mask", "n", "good", "toxic", "s.*")
    mask, prior, own = F.col("mask"), F.col("prior"), F.col("own")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(prior) != 0

    def total(when: Column, what: str | Column = "n") -> Column:
        return F.sum(F.when(when, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")

    share = F.col("n") * (F.lit(120) / F.greatest(F.bit_count(mask), F.lit(1))).cast("long")  # 120 divides by 1 to 5
    sums = rows.groupBy("part", "prior", "own").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(mask == own).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
    at = counters.sparkSession.createDataFrame(steps, "filter_order string, step int, prior int, own int")  # 600 rows
    return sums.join(F.broadcast(at), ["prior", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", ranges: int | None = None) -> DataFrame:
    """The interactions of the five filters over whole ``docs``."""
    return interactions(saved(counted(failures(docs, id_col=id_col, text_col=text_col, part_col=part_col, ranges=ranges), labels)))
