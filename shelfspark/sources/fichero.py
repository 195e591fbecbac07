"""Authority dumps: tab-separated lines with JSON, and lines of a JSON array; mapped to one row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.identifiers import length_only_13

OL_EDITION = "struct<title:string,subtitle:string,isbn_13:array<string>,isbn_10:array<string>,publishers:array<string>,publish_date:string,number_of_pages:string,languages:array<struct<key:string>>,dewey_decimal_class:array<string>,lc_classifications:array<string>,authors:array<struct<key:string>>,series:array<string>>"
BNE_RECORD = "struct<id:string,titulo:string,isbn:string,autores:string,editorial:string,fecha_publicacion:string,extension:string,lengua_principal:string,cdu:string,serie:string>"
#: Language names and codes of the dumps.
LANGUAGES = {"eng": "en", "spa": "es", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "ita": "it", "por": "pt", "cat": "ca", "español": "es", "inglés": "en", "francés": "fr", "alemán": "de", "italiano": "it", "portugués": "pt", "catalán": "ca"}


def year(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), r"(1[0-9]{3}|20[0-9]{2})", 1).try_cast("int")


def pages(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), r"(\d{1,5})", 1).try_cast("int")


def language(c: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(c), "^/languages/", ""))
    known = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    return F.element_at(known, key)


def udc(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"/\*+/.*$", "")), F.lit(""))


def read_ol(spark: SparkSession, path: str, kind: str = "/type/edition") -> DataFrame:
    """Lines of kind, key, revision, date and JSON, split on tabs."""
    parts = F.split("value", "\t", 5)
    return spark.read.text(path).where(F.col("value").startswith(kind)).select(F.get(parts, F.lit(1)).alias("key"), F.get(parts, F.lit(4)).alias("json"))


def read_bne(spark: SparkSession, path: str) -> DataFrame:
    """One record a line of a JSON array; brackets and commas at the ends are cut."""
    line = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\[", ""), r"[,\]]+$", "")
    return spark.read.text(path).select(line.alias("json")).where("json <> ''")


def map_ol(lines: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """Editions as authority rows; author keys become names, in order, without those unknown."""
    e = lines.select("key", F.from_json("json", OL_EDITION).alias("e")).select("key", "e.*")
    one = lambda c: F.get(F.col(c), F.lit(0))
    rows = e.select(
        "key", length_only_13(F.coalesce(one("isbn_13"), one("isbn_10"))).alias("isbn"), one("isbn_10").alias("isbn_10"), F.col("title").alias("titulo"), F.col("subtitle").alias("subtitulo"),
        one("publishers").alias("editorial"), year(F.col("publish_date")).alias("anio_edicion"), language(F.get(F.col("languages.key"), F.lit(0))).alias("idioma"), F.lit(None).cast("string").alias("cdu"),
        one("dewey_decimal_class").alias("dewey"), one("lc_classifications").alias("lcc"), pages(F.col("number_of_pages")).alias("paginas"), one("series").alias("coleccion_nombre"), F.lit("ol").alias("fuente"), F.col("authors.key").alias("_a"),
    )
    if authors is None:
        return rows.withColumn("autores", F.lit(None).cast("string")).drop("_a", "key")
    names = rows.select("key", F.posexplode("_a").alias("pos", "author_key")).join(authors, "author_key").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "name")))["name"], " & ").alias("autores"))
    return rows.drop("_a").join(names, "key", "left").drop("key")


def map_bne(lines: DataFrame) -> DataFrame:
    r = lines.select(F.from_json("json", BNE_RECORD).alias("r")).select("r.*")
    return r.select(
        length_only_13(F.col("isbn")).alias("isbn"), F.lit(None).cast("string").alias("isbn_10"), F.col("titulo"), F.lit(None).cast("string").alias("subtitulo"), "editorial", year(F.col("fecha_publicacion")).alias("anio_edicion"),
        language(F.col("lengua_principal")).alias("idioma"), udc(F.col("cdu")).alias("cdu"), F.lit(None).cast("string").alias("dewey"), F.lit(None).cast("string").alias("lcc"), pages(F.col("extension")).alias("paginas"), F.col("serie").alias("coleccion_nombre"), F.lit("bne").alias("fuente"), "autores",
    )


def by_isbn(rows: DataFrame, path: str, buckets: int = 200) -> None:
    """Written in ranges of the ISBN, so that a look-up reads the row groups whose bounds hold it."""
    rows.repartitionByRange(buckets, "isbn").sortWithinPartitions("isbn").write.mode("overwrite").parquet(path)
