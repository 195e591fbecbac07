"""Preference formatting for chat training.

A pair of a chosen and a rejected conversation shares its first turns; the longest common prefix of turns (equal role
and equal text) is rendered once as the prompt, and what follows on either side becomes a completion, rendered turn by
turn with a loss mask: 1 for the characters of assistant turns, 0 for the rest.  Everything is array functions on one
row a pair.

Defined results: a null or empty conversation is one without turns; a null role or text counts as empty; equal
conversations give a prompt and two empty completions and are not ``distinct``; a turn number that repeats keeps both
turns, in the order of role and text; extra columns stay, but for those named like a column of the result, which gives
way to it.  One conversation is one row, so its turns have to fit into a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.neighbours import with_next

RESULT = ("prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask", "distinct", "_a", "_b", "_p", "_c", "_r")
#: How a turn is written.
OPEN, CLOSE, END = "<|", "|>\n", "\n"


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are the same."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differ, F.lit(0)), n)).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def masked(turns: Column) -> Column:
    """Spans of a completion: start and end character, and whether they are trained on."""
    size = lambda t: F.char_length(t["role"]) + F.char_length(t["text"]) + len(OPEN) + len(CLOSE) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,train:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        body = s["at"] + F.char_length(t["role"]) + len(OPEN) + len(CLOSE)
        end = s["at"] + size(t)
        own = (t["role"] == "assistant").cast("int")
        spans = F.array(F.struct(s["at"].alias("start"), body.alias("end"), F.lit(0).alias("train")), F.struct(body.alias("start"), end.alias("end"), own.alias("train")))
        return F.struct(end.alias("at"), F.concat(s["spans"], spans).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, *, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with ``prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask, distinct``.

    ``chosen`` and ``rejected`` are arrays of turns, each a struct of ``role`` and ``text``.
    """
    turns = "array<struct<role:string,text:string>>"
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(turns)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    others = [c for c in pairs.columns if c not in (chosen, rejected, *RESULT)]
    rows = pairs.select(*others, clean(chosen).alias("_a"), clean(rejected).alias("_b"))
    rows = rows.withColumn("prompt_turns", common_turns(F.col("_a"), F.col("_b")))
    rest = lambda c: F.when(F.size(c) > F.col("prompt_turns"), F.slice(c, F.col("prompt_turns") + 1, F.size(c))).otherwise(F.array().cast(turns))
    rows = rows.select(*others, "prompt_turns", F.slice("_a", F.lit(1), F.col("prompt_turns")).alias("_p"), rest("_a").alias("_c"), rest("_b").alias("_r"))
    return rows.select(
        *others, "prompt_turns", rendered(F.col("_p")).alias("prompt"),
        rendered(F.col("_c")).alias("chosen_text"), masked(F.col("_c")).alias("chosen_mask"),
        rendered(F.col("_r")).alias("rejected_text"), masked(F.col("_r")).alias("rejected_mask"),
        (F.size("_c") + F.size("_r") > 0).alias("distinct"),
    )


def gathered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` from rows ``conv_id, turn, role, text``; rows without conv_id are left out."""
    key = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(key)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def borrowed_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected``: each conversation, and itself with its last assistant turn's text taken from the
    last assistant turn of the next conversation (or left out if that has none)."""
    talks = gathered(turns)
    answers = lambda c: F.filter(c, lambda t: t["role"] == "assistant")
    last = lambda c: F.get(answers(c), F.size(answers(c)) - 1)["text"]
    order = with_next(turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), "conv_id")
    given = talks.select(F.col("conv_id").alias("next_key"), last(F.col("turns")).alias("other"))
    rows = talks.join(order.join(given, "next_key").select("conv_id", "other"), "conv_id")
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    at = F.get(places, F.size(places) - 1)
    swapped = F.filter(F.transform("turns", lambda t, i: F.when(i == at, F.when(F.col("other").isNotNull(), F.struct(t["role"].alias("role"), F.col("other").alias("text")))).otherwise(t)), lambda t: t.isNotNull())
    return rows.select("conv_id", F.col("turns").alias("chosen"), F.when(at.isNull(), F.col("turns")).otherwise(swapped).alias("rejected"))
