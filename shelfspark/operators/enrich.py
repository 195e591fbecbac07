"""Enrichment: each field's value from the best source that has one, where it came from, and what may replace what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.identifiers import isbn, issn
from shelfspark.functions.names import is_author_artefact, is_title_artefact
from shelfspark.model import absent

#: Sources from the most to the least trusted.
LADDER = ("cip", "fichero", "openlibrary", "google", "pista", "dnb", "bnf", "cdu")


def ladder(candidates: DataFrame, fields: list[str], sources: tuple[str, ...] = LADDER, only: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``_id``, the fields and ``procedencia`` (field to source) from rows ``_id, fuente, fields``, by one aggregate.

    A field takes the first source in order that has a value which is neither null, blank nor an empty list; ``only`` restricts
    a field to some sources.  Sources that the order doesn't know are not asked; of several rows of one source the smallest value counts.
    """
    rank = F.coalesce(*(F.when(F.col("fuente") == s, F.lit(i)) for i, s in enumerate(sources)))
    kinds = {f.name: f.dataType.typeName() for f in candidates.schema.fields}

    def best(c: str) -> Column:
        there = (F.size(c) > 0) if kinds[c] == "array" else (F.trim(F.col(c).cast("string")) != "")
        allowed = F.col("fuente").isin(*only[c]) if only and c in only else F.lit(True)
        return F.min(F.when(there & allowed & F.col("_rank").isNotNull(), F.struct("_rank", F.col(c).alias("v"), "fuente"))).alias(f"_{c}")

    got = candidates.withColumn("_rank", rank).groupBy("_id").agg(*map(best, fields))
    entries = F.array(*(F.when(F.col(f"_{c}").isNotNull(), F.struct(F.lit(c).alias("k"), F.col(f"_{c}.fuente").alias("v"))) for c in fields))
    return got.select("_id", *(F.col(f"_{c}.v").alias(c) for c in fields), F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("procedencia"))


#: Fields that are only filled where they are missing.
FILLED = ("sinopsis", "subtitulo", "anio_edicion", "idioma_original", "cdu_adicionales", "dewey", "lcc", "palabras_clave", "coleccion_nombre", "coleccion_numero", "paginas", "dimensiones")


def enriched(docs: DataFrame, found: DataFrame, *, false_publisher: Column | None = None, publisher_of_series: DataFrame | None = None) -> DataFrame:
    """``docs`` after what a :func:`ladder` found, with ``alertas_agente`` for each replacement and the status.

    Title and authors are replaced only if they come from a cataloguing block (``de_cip``) or can't be trusted; a false publisher
    (a condition on ``editorial``) by that of the series (``coleccion_nombre, editorial``) or the one found; the ISBN by the found one, but a volume
    (``es_tomo``) keeps its own; a blocked (``isbn_bloqueado``) or invalid one goes; magazines' ISBN stays.  Other fields are filled, never
    replaced.  A row that nothing was found for is still checked.
    """
    own = set(docs.columns)
    gained = [c for c in found.columns if c not in ("_id", "procedencia")]
    rows = docs.join(found.select("_id", *(F.col(c).alias(f"_{c}") for c in gained), F.col("procedencia").alias("_from")), "_id", "left")
    new = lambda c: F.col(f"_{c}") if c in gained else F.lit(None)
    if publisher_of_series is not None:
        known = publisher_of_series.select(F.col("coleccion_nombre").alias("_series"), F.col("editorial").alias("_of_series"))
        rows = rows.withColumn("_series", F.coalesce("coleccion_nombre", new("coleccion_nombre").cast("string"))).join(known, "_series", "left")
    else:
        rows = rows.withColumn("_of_series", F.lit(None).cast("string"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in own else F.lit(False)
    blank = lambda c: absent(F.trim(F.col(c).cast("string")))
    magazine = F.col("tipo_recurso").eqNullSafe("revista")

    doubtful_title = blank("titulo") | isbn(F.col("titulo")).isNotNull() | issn(F.col("titulo")).isNotNull() | is_title_artefact(F.col("titulo")) | flag("de_cip")
    title = F.when(doubtful_title & new("titulo").isNotNull(), new("titulo")).otherwise(F.col("titulo"))
    nobody = F.col("autores").isNull() | F.forall("autores", is_author_artefact)
    authors = F.when((nobody | flag("de_cip")) & new("autores").isNotNull(), new("autores")).otherwise(F.col("autores"))
    false = F.coalesce(false_publisher, F.lit(False)) if false_publisher is not None else F.lit(False)
    better = F.coalesce("_of_series", new("editorial"))
    publisher = F.when((false | blank("editorial")) & better.isNotNull(), better).otherwise(F.col("editorial"))
    wanted = F.when(flag("es_tomo"), F.coalesce(F.when(~blank("isbn"), F.col("isbn")), new("isbn"))).otherwise(F.coalesce(new("isbn"), F.when(~blank("isbn"), F.col("isbn"))))
    number = F.when(flag("isbn_bloqueado"), F.lit(None)).when(magazine, F.col("isbn")).otherwise(isbn(wanted))
    serial = issn(F.coalesce(F.when(~blank("issn"), F.col("issn")), new("issn")))
    code = F.coalesce(F.when(~blank("cdu"), F.col("cdu")), new("cdu"))

    replaced = lambda what, old, now: F.when(old.isNotNull() & ~now.eqNullSafe(old), F.concat(F.lit(f"{what} sustituido: "), F.substring(old, 1, 50)))
    alerts = F.filter(F.array(
        replaced("título", F.when(~blank("titulo"), F.col("titulo")), title), replaced("autor", F.array_join("autores", "; "), F.array_join(authors, "; ")), replaced("editorial", F.when(~blank("editorial"), F.col("editorial")), publisher),
        F.when(code.isNull(), F.lit("CDU sin resolver")), F.when(~flag("isbn_bloqueado") & ~magazine & wanted.isNotNull() & isbn(wanted).isNull(), F.concat(F.lit("ISBN descartado: "), wanted)),
    ), lambda x: x.isNotNull())
    values = {"titulo": title, "autores": authors, "editorial": publisher, "isbn": number, "issn": serial, "cdu": F.coalesce(code, F.lit("000")), "idioma": F.coalesce(F.when(~blank("idioma"), F.col("idioma")), new("idioma"), F.lit("es"))}
    for c in FILLED:
        if c in own and c in gained:
            kind = docs.schema[c].dataType.typeName()
            values[c] = F.coalesce(F.when((F.size(c) > 0) if kind == "array" else ~blank(c), F.col(c)), new(c))
    out = rows.withColumn("_alerts", alerts).withColumns(values)
    artefact = blank("titulo") | is_title_artefact(F.col("titulo"))
    done = ~artefact & (F.col("isbn").isNotNull() | F.col("issn").isNotNull())
    out = out.withColumns({
        "alertas_agente": F.array_union(F.coalesce("alertas_agente", F.array().cast("array<string>")) if "alertas_agente" in own else F.array().cast("array<string>"), F.col("_alerts")),
        "estado_verificacion": F.when(done, "completado").otherwise("pendiente"), "revision_requerida": F.when(artefact, True).otherwise(flag("revision_requerida")), "procedencia": F.coalesce("_from", F.create_map().cast("map<string,string>")),
    })
    return out.select(*docs.columns, *[c for c in ("alertas_agente", "estado_verificacion", "revision_requerida", "procedencia") if c not in own])


def reclassified(docs: DataFrame, candidates: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """``_id, de, a, fuente`` of the documents whose publisher the best source names otherwise; case and blanks don't count."""
    best = ladder(candidates, ["editorial"], sources).select("_id", F.col("editorial").alias("a"), F.col("procedencia")["editorial"].alias("fuente"))
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    rows = docs.select("_id", F.col("editorial").alias("de")).join(best, "_id").where(F.col("a").isNotNull())
    return rows.where(plain(F.col("de")) != plain(F.col("a")))


def transitions(changes: DataFrame) -> DataFrame:
    """``de, a, n, fuentes`` of a reclassification, most frequent first."""
    return changes.groupBy("de", "a").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("fuente")).alias("fuentes")).orderBy(F.desc("n"), "de", "a")
