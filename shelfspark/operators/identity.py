"""What an incoming record is: a new document, more of a known one, or a copy; works, issues and numbers that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.identifiers import isbn_variants
from shelfspark.model import absent, natural_key
from shelfspark.operators.numbers import prefix


def identity_key(row: str = "") -> Column:
    """The one key besides its content that a record is known by, as text; null for none.

    A volume is its work and number, an issue its masthead and issue key (without a masthead: title, year and month), an article its DOI,
    another book its ISBN and format.  Volumes are never known by an ISBN, issues never by an ISSN.
    """
    join = lambda kind, *c: F.when(F.forall(F.array(*(x.isNotNull() for x in c)), lambda x: x), F.to_json(F.array(F.lit(kind), *(x.cast("string") for x in c))))
    there = lambda c: F.when(~absent(F.col(c).cast("string")), F.col(c))
    volume = join("obra", there("obra"), there("volumen_numero"))
    issue = F.when(there("coleccion").isNotNull(), join("numero", there("coleccion"), there("clave_numero"))).otherwise(F.coalesce(join("mes", there("titulo"), there("anio_edicion"), there("mes_publicacion")), join("anio", there("titulo"), there("anio_edicion"))))
    article = join("doi", there("doi"))
    book = F.when(there("obra").isNull(), join("isbn", there("isbn"), F.coalesce(F.get("formatos", F.lit(0)), F.lit(""))))
    kind = F.col("tipo_recurso")
    return F.when(volume.isNotNull(), volume).when(kind.eqNullSafe("revista"), issue).when(kind.eqNullSafe("articulo") & article.isNotNull(), article).otherwise(book)


def identified(docs: DataFrame, id_col: str = "_id") -> DataFrame:
    """``id, target, operacion`` of each record, in the order of ids.

    Equal content (``hash_contenido``) is an update under the same file name and ``duplicado_exacto`` under another.  Else a record whose key
    the first document with that key shares is an update of it, unless both have a file name and these differ: then it is a document of its
    own.  A target is always a document that stays: content points to its first record, and that to the first of its key, which points to itself.
    """
    name = F.when(~absent(F.col("nombre_archivo")), F.col("nombre_archivo"))
    rows = docs.select(F.col(id_col).alias("_id"), F.when(~absent(F.col("hash_contenido")), F.col("hash_contenido")).alias("_hash"), name.alias("_name"), identity_key().alias("_key"))
    same = rows.where("_hash is not null").groupBy("_hash").agg(F.min(F.struct("_id", "_name")).alias("_h"))
    rows = rows.join(same, "_hash", "left").withColumn("_first", F.coalesce("_h._id", "_id"))
    alone = rows.where("_first = _id and _key is not null")
    # the first document of a key has the first file name that came with the key
    of_key = alone.groupBy("_key").agg(F.min("_id").alias("_owner"), F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("_id"))).alias("_owner_name"), F.min(F.when(F.col("_name").isNotNull(), F.col("_id"))).alias("_named_at"))
    judged = alone.join(of_key, "_key")
    nameless = F.col("_name").isNull() & (~F.col("_key").startswith('["isbn"') | F.col("_named_at").isNull() | (F.col("_named_at") > F.col("_id")))
    joins = (F.col("_id") != F.col("_owner")) & (nameless | (F.col("_name") == F.col("_owner_name")))
    own = judged.where(F.coalesce(joins, F.lit(False))).select(F.col("_id").alias("_first"), "_owner")
    out = rows.join(own, "_first", "left")
    copy = F.col("_first") != F.col("_id")
    kind = F.when(copy & F.col("_name").eqNullSafe(F.col("_h._name")), "actualizacion").when(copy, "duplicado_exacto").when(F.col("_owner").isNotNull(), "actualizacion").otherwise("insercion")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_owner", "_first").alias("target"), kind.alias("operacion"))


def safe_volume_isbns(docs: DataFrame, id_col: str = "_id") -> DataFrame:
    """``docs`` in which a volume has no ISBN that is its work's, or that an earlier other document has; the latter asks for review."""
    owner = docs.where(~absent(F.col("isbn"))).groupBy("isbn").agg(F.min(F.struct(F.col(id_col).alias("id"), "obra", "volumen_numero")).alias("_o"))
    rows = docs.join(owner, "isbn", "left")
    volume = F.col("obra").isNotNull() & ~absent(F.col("isbn"))
    of_set = F.coalesce(F.arrays_overlap(isbn_variants(F.col("isbn")), isbn_variants(F.col("isbn_obra"))), F.lit(False))
    mine = (F.col("_o.id") == F.col(id_col)) | (F.col("_o.obra").eqNullSafe(F.col("obra")) & (F.col("_o.volumen_numero") == F.col("volumen_numero")))
    taken = volume & ~of_set & ~F.coalesce(mine, F.lit(False))
    old = F.coalesce(F.col("revision_requerida"), F.lit(False)) if "revision_requerida" in docs.columns else F.lit(False)
    out = rows.withColumns({"revision_requerida": old | taken, "isbn": F.when((volume & of_set) | taken, F.lit(None)).otherwise(F.col("isbn"))})
    return out.select(*docs.columns, *([] if "revision_requerida" in docs.columns else ["revision_requerida"]))


def inherited_mark(docs: DataFrame, works: DataFrame, series: DataFrame) -> DataFrame:
    """``docs`` marked as adult if they are themselves, or their work or series is."""
    of = lambda d, key: d.where(F.col("nsfw").eqNullSafe(True)).select(F.col("_id").alias(key), F.lit(True).alias(f"_{key}")).distinct()
    rows = docs.join(of(works, "obra"), "obra", "left").join(of(series, "coleccion"), "coleccion", "left")
    return rows.withColumn("nsfw", F.when(F.coalesce("_obra", "_coleccion", F.lit(False)), F.lit(True)).otherwise(F.col("nsfw"))).select(docs.columns)


def resolved_works(rows: DataFrame, works: DataFrame, id_col: str = "_id") -> tuple[DataFrame, DataFrame]:
    """``rows`` (``titulo_obra, isbn_obra, editorial, coleccion, cdu, total``) with their ``obra``, and the works after them.

    A work is known by its ISBN, else by its title; else it is new, and known by the first of these that it has.  Gaps of a work are filled from
    the row of the smallest id that has a value; its total only rises.  A row with neither has no work.
    """
    title = F.when(F.trim("titulo_obra") != "", F.trim("titulo_obra"))
    number = F.when(~absent(F.col("isbn_obra")), F.col("isbn_obra"))
    by = lambda c: works.where(~absent(F.col(c))).groupBy(F.col(c).alias(f"_{c}")).agg(F.min("_id").alias(f"_by_{c}"))
    out = rows.withColumns({"_isbn_obra": number, "_titulo": title}).join(by("isbn_obra"), "_isbn_obra", "left").join(by("titulo"), "_titulo", "left")
    fresh = F.coalesce("_isbn_obra", "_titulo")
    out = out.withColumn("obra", F.coalesce("_by_isbn_obra", "_by_titulo", F.when(fresh.isNotNull(), F.concat(F.lit("new:"), F.sha1(fresh)))))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(id_col)))
    said = out.where("obra is not null").groupBy(F.col("obra").alias("_id")).agg(
        first(F.col("_titulo")).alias("_t"), first(F.col("_isbn_obra")).alias("_i"), first(F.col("editorial")).alias("_e"), first(F.col("coleccion")).alias("_c"), first(F.col("cdu")).alias("_u"), F.max("total").alias("_n"),
    )
    merged = works.join(said, "_id", "full")
    filled = {c: F.coalesce(F.when(~absent(F.col(c).cast("string")), F.col(c)), F.col(s)) for c, s in (("titulo", "_t"), ("isbn_obra", "_i"), ("editorial", "_e"), ("coleccion", "_c"), ("cdu", "_u"))}
    merged = merged.withColumns(filled | {"total": F.greatest(F.col("total"), F.col("_n"))}).select(works.columns)
    return out.select(*rows.columns, "obra"), merged


def issues(docs: DataFrame, id_col: str = "_id") -> DataFrame:
    """For each series its issues in natural order of their keys, how many there are, and the documents without a key, which ask for review.

    Of several documents of one issue the last one registered (the largest id) is listed.
    """
    rows = docs.where(F.col("coleccion").isNotNull()).withColumn("_key", F.when(~absent(F.col("clave_numero")), F.col("clave_numero")))
    last = rows.where("_key is not null").groupBy("coleccion", "_key").agg(F.max(id_col).alias("_id"))
    dated = last.groupBy("coleccion").agg(F.array_sort(F.collect_list(F.struct(natural_key(F.col("_key")).alias("n"), F.col("_key").alias("clave"), "_id"))).alias("x"))
    loose = rows.where("_key is null").groupBy("coleccion").agg(F.array_sort(F.collect_list(F.col(id_col))).alias("sin_fecha"))
    out = dated.join(loose, "coleccion", "full")
    none = F.coalesce("sin_fecha", F.array().cast(loose.schema["sin_fecha"].dataType))
    numbers = F.coalesce(F.transform("x", lambda i: F.struct(i["clave"].alias("clave"), i["_id"].alias("_id"))), F.array().cast(f"array<struct<clave:string,_id:{docs.schema[id_col].dataType.simpleString()}>>"))
    return out.select("coleccion", numbers.alias("numeros"), F.size(numbers).alias("presentes"), none.alias("sin_fecha"), (F.size(none) > 0).alias("revision"))


def numbered_after(docs: DataFrame, id_col: str = "_id") -> DataFrame:
    """Members of a series without a number, numbered on from its largest number, in order of ids; ``auto`` tells them."""
    n = F.regexp_extract(F.coalesce(F.col("coleccion_numero").cast("string"), F.lit("")), r"^\s*(\d+)", 1).try_cast("long")
    rows = docs.withColumn("_n", n)
    most = rows.where("coleccion is not null").groupBy("coleccion").agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
    without = prefix(rows.where("_n is null and coleccion is not null").select(F.col(id_col), "coleccion"), "coleccion", [id_col], _k=("sum", F.lit(1).cast("long"))).select(id_col, "_k")
    out = rows.join(most, "coleccion", "left").join(without, id_col, "left").withColumn("auto", F.col("_k").isNotNull())
    return out.withColumn("coleccion_numero", F.when(F.col("auto"), (F.col("_most") + F.col("_k")).cast("string")).otherwise(F.col("coleccion_numero"))).select(*docs.columns, "auto")
