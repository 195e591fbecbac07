"""People under several spellings, and several people under one name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from shelfspark.functions.names import split_authors
from shelfspark.model import ACCENTED, folded
from shelfspark.shipping import shipped

#: How many words a known name may have to be found inside a longer one.
LONGEST = 5


def references(docs: DataFrame) -> DataFrame:
    """``_id, n``: in how many documents a person is an author or a contributor."""
    people = F.array_union(F.coalesce("autores", F.array().cast("array<string>")), F.coalesce(F.transform("contribuciones", lambda c: c["persona"]), F.array().cast("array<string>")))
    return docs.select(F.explode(F.array_distinct(people)).alias("_id")).where("_id is not null").groupBy("_id").agg(F.count("*").alias("n"))


def spellings(people: DataFrame, counts: DataFrame) -> DataFrame:
    """``old, new``: people of one name, accents and case aside, into the best spelling: not all capitals, then more accents, then more documents, then the smaller id."""
    key = F.trim(F.regexp_replace(folded(F.col("nombre")), r"\s+", " "))
    rows = people.select("_id", "nombre", key.alias("k")).where("k <> ''").join(counts, "_id", "left")
    capitals = (F.col("nombre") == F.upper("nombre")) & (F.col("nombre") != F.lower("nombre"))
    accents = F.char_length("nombre") - F.char_length(F.translate(F.lower("nombre"), ACCENTED, ""))
    order = F.struct(capitals.alias("a"), (-accents).alias("b"), (-F.coalesce("n", F.lit(0))).alias("c"), F.col("_id").alias("id"))
    best = rows.groupBy("k").agg(F.min(order).alias("best"), F.count("*").alias("_many")).where("_many > 1")
    return rows.join(best, "k").where(F.col("_id") != F.col("best.id")).select(F.col("_id").alias("old"), F.col("best.id").alias("new"))


def _key(words) -> object:
    return F.array_join(F.array_sort(words), " ")


@F.pandas_udf(ArrayType(StringType()))
def _best_cut(n: pd.Series, spans: pd.Series) -> pd.Series:
    """The fewest known names that lie end to end over all ``n`` words; the smallest ids among equals, null without any."""
    out = []
    for words, found in zip(n, spans, strict=True):
        best: list[tuple | None] = [(0, ())] + [None] * int(words)
        by_end: dict[int, list] = {}
        for s in found:
            by_end.setdefault(int(s["at"] + s["len"]), []).append((int(s["at"]), s["person"]))
        for end in range(1, int(words) + 1):
            ways = [(best[at][0] + 1, (*best[at][1], who)) for at, who in by_end.get(end, ()) if best[at] is not None]
            best[end] = min(ways, default=None)
        out.append(list(best[-1][1]) if best[-1] is not None and best[-1][0] > 1 else None)
    return pd.Series(out)


def fused(people: DataFrame) -> DataFrame:
    """``old, parts``: people whose name is several, by joiners (``&``, ``;``, a slash) or as known names one after the other.

    Parts are ids of known people, or ``new:`` and a hash of a name that nobody has.  Inside a name, spans of up to five words meet the
    known names by their words in any order, and the cut with the fewest names that covers all words is taken.
    """
    shipped(people.sparkSession)
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))
    named = people.select("_id", "nombre", tidy(F.col("nombre")).alias("k")).where("k <> ''").withColumn("w", F.split("k", " "))
    known = named.groupBy(_key(F.col("w")).alias("key")).agg(F.min("_id").alias("person"))
    cut = named.select("_id", split_authors(F.col("nombre")).alias("p")).where(F.size("p") > 1)
    parts = cut.select("_id", F.posexplode("p").alias("at", "name")).withColumn("key", _key(F.split(tidy(F.col("name")), " "))).join(known, "key", "left")
    joined = parts.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("person", F.concat(F.lit("new:"), F.sha1("key"))).alias("person")))).alias("x")).select(F.col("_id").alias("old"), F.col("x.person").alias("parts"))
    whole = named.join(cut, "_id", "left_anti").where(F.size("w") >= 4)
    n = F.size("w")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST), n - 2)), lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("at"), k.alias("len"), _key(F.slice("w", i + 1, k)).alias("key")))))
    hits = whole.select("_id", n.alias("n"), F.explode(spans).alias("s")).select("_id", "n", "s.*").join(known, "key").where("person <> _id")
    found = hits.groupBy("_id", "n").agg(F.collect_list(F.struct("at", "len", "person")).alias("spans")).select(F.col("_id").alias("old"), _best_cut("n", "spans").alias("parts")).where("parts is not null")
    return joined.unionByName(found)


def repointed(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Documents that name a person of ``mapping`` (``old, parts``) name all its parts instead, in order, without repeats; contributors keep their role."""
    flat = docs.select("_id", F.posexplode("autores").alias("at", "old"), F.lit(None).cast("string").alias("rol")).unionByName(docs.select("_id", F.posexplode("contribuciones").alias("at", "c")).select("_id", "at", F.col("c.persona").alias("old"), F.coalesce("c.rol", F.lit("")).alias("rol")))
    each = flat.join(mapping, "old", "left").select("_id", "at", "rol", F.posexplode(F.coalesce("parts", F.array("old"))).alias("k", "p"))
    lists = each.groupBy("_id").agg(*(F.array_sort(F.collect_list(F.when(c, F.struct("at", "k", "p", "rol")))).alias(a) for a, c in (("_a", F.col("rol").isNull()), ("_c", F.col("rol").isNotNull()))))
    rows = docs.join(lists, "_id", "left")
    roles = F.array_distinct(F.transform("_c", lambda x: F.struct(x["p"].alias("persona"), F.nullif(x["rol"], F.lit("")).alias("rol"))))
    return rows.withColumns({"autores": F.when(F.size("autores") > 0, F.array_distinct(F.col("_a.p"))).otherwise(F.col("autores")), "contribuciones": F.when(F.size("contribuciones") > 0, roles).otherwise(F.col("contribuciones"))}).select(docs.columns)
