"""People, series, works: resolution, inventories, groupings, decisions between copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.names import canonical_key, volume
from shelfspark.functions.text import same_work
from shelfspark.model import absent, folded
from shelfspark.operators.numbers import gaps


def resolve_people(names: DataFrame, people: DataFrame) -> DataFrame:
    """``name, person``: the known person of a name or alternative name, accents and case aside, or a new id made of it."""
    known = people.select("_id", F.explode(F.array_union(F.array("nombre"), F.coalesce("nombres_alternativos", F.array().cast("array<string>")))).alias("n")).groupBy(folded(F.col("n")).alias("k")).agg(F.min("_id").alias("person"))
    wanted = names.select("name").where(~absent(F.col("name"))).distinct().withColumn("k", folded(F.trim("name")))
    return wanted.join(known, "k", "left").select("name", F.coalesce("person", F.concat(F.lit("new:"), F.sha1("k"))).alias("person"))


def resolve_series(rows: DataFrame, series: DataFrame) -> DataFrame:
    """``rows`` (``nombre, issn``) with the ``serie`` of the same ISSN, else of the same name, else (without an ISSN) of the same canonical key."""
    by = lambda key, name: series.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.min("_id").alias(f"_{name}"))
    out = rows.withColumns({"i": F.col("issn"), "n": folded(F.col("nombre")), "c": F.when(F.col("issn").isNull(), canonical_key(F.col("nombre")))})
    out = out.join(by(F.col("issn"), "i"), "i", "left").join(by(folded(F.col("nombre")), "n"), "n", "left").join(by(canonical_key(F.col("nombre")), "c"), "c", "left")
    return out.withColumn("serie", F.coalesce("_i", "_n", "_c")).drop("i", "n", "c", "_i", "_n", "_c")


def inventory(volumes: DataFrame, works: DataFrame) -> DataFrame:
    """For each work its volumes in order, the runs of numbers that are missing up to the total, and whether it is whole.

    The total is the declared one or the largest number, whichever is larger.  The first document that claims a number keeps
    it; the others, and those without a number, ask for review.  Nothing is counted up to the largest number; what lists every
    number is :func:`listed`.
    """
    first = volumes.where("numero is not null").groupBy("obra", "numero").agg(F.min("_id").alias("_first"))
    judged = volumes.join(first, ["obra", "numero"], "left").withColumn("_keeps", F.coalesce(F.col("_id") == F.col("_first"), F.lit(False)))
    lists = judged.groupBy("obra").agg(
        F.array_sort(F.collect_list(F.when(F.col("_keeps"), F.struct(F.col("numero").cast("long").alias("numero"), "_id")))).alias("volumenes"), F.array_sort(F.collect_list(F.when(~F.col("_keeps"), F.col("_id")))).alias("sin_numero"),
        F.count_if(F.col("_keeps") & (F.col("numero") >= 1)).alias("presentes"), F.max(F.when(F.col("_keeps"), F.col("numero"))).cast("long").alias("_most"),
    )
    missing = gaps(first.select("obra", "numero"), "obra", "numero", works.select("obra", "total")).groupBy("obra").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("huecos"))
    rows = works.select("obra", F.col("total").cast("long").alias("_declared")).join(lists, "obra", "left").join(missing, "obra", "left")
    total = F.greatest(F.coalesce("_declared", F.lit(0)), F.coalesce("_most", F.lit(0)))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    out = rows.select(
        "obra", total.alias("total"), none("volumenes", lists.schema["volumenes"].dataType).alias("volumenes"), none("huecos", missing.schema["huecos"].dataType).alias("huecos"),
        F.coalesce("presentes", F.lit(0)).alias("presentes"), none("sin_numero", lists.schema["sin_numero"].dataType).alias("sin_numero"),
    )
    return out.withColumns({"completa": (F.col("total") > 0) & (F.size("huecos") == 0), "revision": F.size("sin_numero") > 0})


def listed(inventories: DataFrame) -> DataFrame:
    """``obra, numero, _id``: every number from 1 to the total, with its document or null."""
    there = inventories.select("obra", F.explode("volumenes").alias("v")).select("obra", "v.numero", "v._id").where("numero >= 1")
    gone = inventories.select("obra", F.explode("huecos").alias("h")).select("obra", F.explode(F.sequence("h.first", "h.last")).alias("numero"), F.lit(None).cast(there.schema["_id"].dataType).alias("_id"))
    return there.unionByName(gone)


def works_by_folder(files: DataFrame) -> DataFrame:
    """Folders that are works of several volumes: two distinct numbers or more, in half the files or more."""
    v = files.withColumn("v", volume(F.col("nombre")))
    g = v.groupBy("carpeta").agg(F.count("*").alias("n"), F.count("v").alias("numbered"), F.count_distinct("v.number").alias("distinct_numbers"), F.max("v.number").alias("total"))
    return g.where("distinct_numbers >= 2 and numbered * 2 >= n").select("carpeta", "distinct_numbers", "total")


def siblings(titles: DataFrame) -> DataFrame:
    """Titles that differ in a closing number only: same beginning of two words or more, two distinct numbers or more."""
    head = F.trim(F.regexp_extract("titulo", r"^(.*?)[\s,.:;\-–—]*(\d{1,3}|[IVXL]{1,6})\s*$", 1))
    n = F.regexp_extract("titulo", r"(\d{1,3}|[IVXL]{1,6})\s*$", 1)
    rows = titles.select("_id", folded(head).alias("prefix"), n.alias("number")).where((F.size(F.split("prefix", r"\s+")) >= 2) & (F.col("number") != ""))
    good = rows.groupBy("prefix").agg(F.count_distinct("number").alias("k")).where("k >= 2").select("prefix")
    return rows.join(good, "prefix", "left_semi")


def copy_decision(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Which of an existing and an incoming copy to keep and why: legible, identical, more pages, more bytes."""
    say = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    pages = lambda x: F.coalesce(x["pages"], F.lit(0))
    return (
        F.when(a["legible"] & ~b["legible"], say("existing", "legible")).when(~a["legible"] & b["legible"], say("incoming", "legible"))
        .when(a["hash"] == b["hash"], say("existing", "identical"))
        .when(pages(a) > pages(b), say("existing", "pages")).when(pages(b) > pages(a), say("incoming", "pages"))
        .when(b["bytes"] > a["bytes"], say("incoming", "bytes")).otherwise(say("existing", "bytes"))
    )


def cosmetic_groups(files: DataFrame) -> DataFrame:
    """Files of one folder, format and name length whose names are the same work, greedily by the first of each group.

    ``files`` has ``_id, carpeta, formato, clave``; a task holds the files of one folder only.
    """

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        heads, out = [], []
        for i, key in rows.sort_values("_id")[["_id", "clave"]].itertuples(index=False):
            at = next((h for h, k in heads if same_work(k, key)), None)
            if at is None:
                heads.append((i, key))
                at = i
            out.append((i, at))
        return pd.DataFrame(out, columns=["_id", "grupo"])

    return files.withColumn("_n", F.char_length("clave")).groupBy("carpeta", "formato", "_n").applyInPandas(group, "_id string, grupo string")


def agreement(mine: Column, other: Column) -> Column:
    """How two UDC codes agree: exact, same area (first digit), fills, no data, differs."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    a, b = clean(mine), clean(other)
    return F.when((a == "") & (b == ""), "sin_datos").when(a == "", "rellena").when(b == "", "sin_datos").when(a == b, "exacto").when(F.substring(a, 1, 1) == F.substring(b, 1, 1), "misma_area").otherwise("difiere")


def relocate(lost: DataFrame, found: DataFrame) -> DataFrame:
    """Where lost files (``_id, nombre``) are now: one hit repairs, several are ambiguous, none is absent."""
    hits = found.groupBy("nombre").agg(F.count("*").alias("n"), F.min("ruta").alias("ruta"))
    n = F.coalesce("n", F.lit(0))
    return lost.join(hits, "nombre", "left").select("_id", F.when(n == 1, "reparar").when(n > 1, "ambiguo").otherwise("ausente").alias("estado"), F.when(n == 1, F.col("ruta")).alias("ruta"))
