"""Images matched to documents by names in which some characters can't be read.

Two names are one work if they are equal, or of one length with unreadable characters (``?``) in at most a quarter of the places
(one in a short name) where they differ.  Names meet on what is left of them once the places are hidden that either can't read, and
are then verified.  Distinct names meet, not files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.clusters import written

UNREADABLE = "?"


def allowed(n: Column) -> Column:
    """How many places of a name of ``n`` characters may differ."""
    return F.greatest(F.lit(1), F.floor(n / 4).cast("int"))


def same_name(a: Column, b: Column) -> Column:
    """Equal, or of one length and different only where one side can't be read, in few enough places."""
    letters = lambda c: F.split(c, "")
    differ = F.filter(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x != y, (x == UNREADABLE) | (y == UNREADABLE))), lambda x: x.isNotNull())
    return (a == b) | ((F.char_length(a) == F.char_length(b)) & F.forall(differ, lambda x: x) & (F.size(differ) <= allowed(F.char_length(a))))


def _lost(names: DataFrame) -> DataFrame:
    """``name, n, lost``: a name's length and the places (from 1) of its unreadable characters, comma-joined; none is empty."""
    at = F.filter(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.substr("name", i, F.lit(1)) == UNREADABLE)
    return names.select("name", F.char_length("name").alias("n"), F.array_join(at, ",").alias("lost"))


def _without(name: Column, places: Column) -> Column:
    """The name with the places (comma-joined, from 1) taken out of sight."""
    gone = F.filter(F.split(places, ","), lambda x: x != "")
    return F.aggregate(gone, name, lambda s, p: F.overlay(s, F.lit(UNREADABLE), p.cast("int"), F.lit(1)))


def same_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a, b`` of all pairs of distinct names (``name``) of the two sides that are one work.

    Two names fit if they are the same once the places that either can't read are hidden in both.  So a name is written
    once for each distinct set of places of the other side's names of its length, and names meet on what is left in
    sight: only pairs that fit, or fit but for the number of places, meet at all.
    """
    a, b = written(_lost(a.select("name").where("name <> ''").distinct())), written(_lost(b.select("name").where("name <> ''").distinct()))

    def seen(x: DataFrame, y: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        """``own, n, mine, other, sight``: each name of ``x`` with each set of places of ``y``."""
        sets = y.select("n", F.col("lost").alias(other)).distinct()
        return x.withColumnsRenamed({"name": own, "lost": mine}).join(sets, "n").withColumn("sight", _without(F.col(own), F.col(other)))

    hide = lambda d, places: d.withColumn("sight", _without(F.col("sight"), F.col(places)))
    left, right = hide(seen(a, b, "a", "_la", "_lb"), "_la"), hide(seen(b, a, "b", "_lb", "_la"), "_lb")
    met = left.join(right.select("b", "_la", "_lb", "sight"), ["_la", "_lb", "sight"])
    return met.where(same_name(F.col("a"), F.col("b"))).select("a", "b")


def matched(images: DataFrame, docs: DataFrame) -> DataFrame:
    """``image, state, doc, n``: each image is paired with its one document, ambiguous, or without one.

    ``images`` and ``docs`` have ``_id, name``.  An image that fits several documents, and images that fit the same one, are
    ambiguous; ``n`` says how many documents an image fits.  Documents of a name are counted, not listed.
    """
    pairs = same_names(images, docs)
    of_name = docs.where("name <> ''").groupBy(F.col("name").alias("b")).agg(F.count("*").alias("_k"), F.min("_id").alias("_doc"))
    fits = pairs.join(of_name, "b").groupBy(F.col("a").alias("name")).agg(F.sum("_k").alias("n"), F.min("_doc").alias("doc"))
    rows = written(images.select(F.col("_id").alias("image"), "name").join(fits, "name", "left").select("image", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") == 1, F.col("doc")).alias("doc")))
    claims = rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("_claims"))
    state = F.when(F.col("n") == 0, "sin_coincidencia").when((F.col("n") > 1) | (F.col("_claims") > 1), "ambiguo").otherwise("emparejado")
    out = rows.join(claims, "doc", "left").select("image", state.alias("state"), "doc", "n")
    return out.withColumn("doc", F.when(F.col("state") == "emparejado", F.col("doc")))
