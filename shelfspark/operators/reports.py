"""Reports and small rules of upkeep: what is pending, missing, doubtful; each is one plan over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.classification import dewey_to_udc, lcc_to_udc, udc_clean
from shelfspark.functions.identifiers import isbn13_key, isbn_variants
from shelfspark.model import absent, folded, ne_true

POOR = ("0", "00", "000")


def normal_code(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))


def pending_codes(docs: DataFrame, learnt: DataFrame) -> DataFrame:
    """``sistema, codigo``: Dewey and (of documents without one) LCC codes that could give a poor UDC code, neither learnt nor in the fixed crosswalk.

    Volumes and documents whose code was set by hand are left out.
    """
    poor = docs.where((F.col("cdu").isNull() | F.col("cdu").isin(*POOR)) & F.col("obra").isNull() & ne_true(F.col("cdu_manual")))
    of = lambda d, s: d.where(~absent(F.col(s))).select(F.lit(s).alias("sistema"), F.col(s).alias("codigo")).distinct()
    codes = of(poor, "dewey").where(dewey_to_udc(F.col("codigo")).isNull()).unionByName(of(poor.where(absent(F.col("dewey"))), "lcc").where(lcc_to_udc(F.col("codigo")).isNull()))
    known = learnt.select(F.col("sistema_origen").alias("sistema"), F.col("codigo_origen").alias("_k")).distinct()
    return codes.withColumn("_k", normal_code(F.col("codigo"))).join(known, ["sistema", "_k"], "left_anti").select("sistema", "codigo")


def missing_descriptions(docs: DataFrame, udc: DataFrame, others: DataFrame) -> DataFrame:
    """``sistema, codigo`` that documents use and no description explains; UDC codes count as they are cleaned for the tree."""
    used = docs.select(F.lit("cdu").alias("sistema"), udc_clean(F.col("cdu")).alias("codigo")).where(F.col("codigo").rlike("[0-9]"))
    for s in ("dewey", "lcc"):
        used = used.unionByName(docs.select(F.lit(s).alias("sistema"), F.trim(F.col(s)).alias("codigo")).where("codigo <> ''"))
    known = udc.select(F.lit("cdu").alias("sistema"), "codigo").unionByName(others.select("sistema", "codigo"))
    return used.distinct().join(known.distinct(), ["sistema", "codigo"], "left_anti")


def enrichable_people(docs: DataFrame, people: DataFrame) -> DataFrame:
    """``_id, nombre`` of people who are an author of some document and lack a biography or a picture."""
    used = docs.select(F.explode("autores").alias("_id")).distinct()
    return people.where(absent(F.col("biografia")) | absent(F.col("foto"))).join(used, "_id", "left_semi").select("_id", "nombre")


def title_words(c: Column) -> Column:
    """The distinct folded words of three letters or more."""
    return F.array_distinct(F.filter(F.split(folded(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= 3))


def alike_titles(a: Column, b: Column, share: float = 0.6) -> Column:
    """Whether two lists of title words share that part of the shorter one; a title without words is like none."""
    least = F.least(F.size(a), F.size(b))
    return (least > 0) & (F.size(F.array_intersect(a, b)) >= share * least)


def authority_match(docs: DataFrame, authority: DataFrame, id_col: str = "_id") -> DataFrame:
    """``id, authority titles``: ``titulo_autoridad``, ``estado``: each document's ISBN looked up, and its title held against what is found.

    ``coincide`` if some title of that ISBN is alike, ``difiere`` if none is, ``ausente`` if the ISBN isn't there, ``sin_isbn`` without a valid one.
    Of several authority rows an alike one goes first, then the smallest title.
    """
    known = authority.select(isbn13_key(F.col("isbn")).alias("_k"), F.col("titulo").alias("_t")).where("_k is not null")
    rows = docs.select(F.col(id_col), F.col("titulo"), isbn13_key(F.col("isbn")).alias("_k")).join(known, "_k", "left")
    rows = rows.withColumn("_alike", alike_titles(title_words(F.col("titulo")), title_words(F.col("_t"))))
    best = rows.groupBy(id_col).agg(F.min(F.when(F.col("_t").isNotNull(), F.struct((~F.col("_alike")).alias("far"), F.col("_t").alias("t")))).alias("x"), F.max("_k").alias("_k"))
    state = F.when(F.col("_k").isNull(), "sin_isbn").when(F.col("x").isNull(), "ausente").when(F.col("x.far"), "difiere").otherwise("coincide")
    return best.select(id_col, F.col("x.t").alias("titulo_autoridad"), state.alias("estado"))


def isbn_audit(docs: DataFrame, authority: DataFrame, often: int = 4) -> DataFrame:
    """One report ``parte, clave, n``: ISBNs by how many documents have them, those that more than ``often`` have, and how titles agree with the authority."""
    per = docs.where(~absent(F.col("isbn"))).groupBy("isbn").agg(F.count("*").alias("k"))
    bucket = F.when(F.col("k") <= 4, F.col("k").cast("string")).when(F.col("k") <= 10, "5-10").when(F.col("k") <= 50, "11-50").otherwise("51+")
    part = lambda d, name: d.select(F.lit(name).alias("parte"), "clave", F.col("n").cast("long").alias("n"))
    histogram = part(per.groupBy(bucket.alias("clave")).agg(F.count("*").alias("n")), "repeticiones")
    suspicious = part(per.where(F.col("k") > often).select(F.col("isbn").alias("clave"), F.col("k").alias("n")), "sospechosos")
    agreed = part(authority_match(docs, authority).groupBy(F.col("estado").alias("clave")).agg(F.count("*").alias("n")), "autoridad")
    return reduce(DataFrame.unionByName, (histogram, suspicious, agreed))


def title_corrections(docs: DataFrame, authority: DataFrame, id_col: str = "_id") -> DataFrame:
    """``id, accion, titulo``: a title that differs from the authority's for the same ISBN is replaced if the file name is like the latter, else to be reviewed."""
    forms = docs.select(id_col, "titulo", "nombre_archivo", F.explode(isbn_variants(F.col("isbn"))).alias("_i"))
    known = authority.where(F.trim("titulo") != "").groupBy(F.col("isbn").alias("_i")).agg(F.min(F.trim("titulo")).alias("_t"))
    rows = forms.join(known, "_i").groupBy(id_col, "titulo", "nombre_archivo").agg(F.min("_t").alias("_t"))
    plain = lambda c: F.array_join(F.filter(F.split(folded(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    file = F.regexp_replace(F.coalesce("nombre_archivo", F.lit("")), r"\.[^.\s]{1,5}$", "")
    sure = alike_titles(title_words(file), title_words(F.col("_t")))
    return rows.where(plain(F.col("titulo")) != plain(F.col("_t"))).select(id_col, F.when(sure, "aplicar").otherwise("revisar").alias("accion"), F.col("_t").alias("titulo"))


def without_copies(files: DataFrame, folder: str = "carpeta", name: str = "nombre") -> DataFrame:
    """Files without those named "X (2).pdf" whose "X.pdf" lies in the same folder."""
    plain = F.regexp_replace(name, r" \(\d+\)(\.[^.]+)$", "$1")
    there = files.select(F.col(folder).alias("_f"), F.col(name).alias("_n")).distinct()
    rows = files.withColumn("_plain", plain)
    numbered = F.col("_plain") != F.col(name)
    copies = rows.where(numbered).join(there, (F.col(folder) == F.col("_f")) & (F.col("_plain") == F.col("_n")), "left_anti")
    return rows.where(~numbered | F.col(name).isNull()).unionByName(copies).drop("_plain")


def units(files: DataFrame, folder: str = "carpeta", name: str = "nombre") -> DataFrame:
    """``carpeta, unidad, ficheros, imagenes``: every document is a unit of its own, all loose images of a folder are one."""
    image = F.lower(name).rlike(r"\.(?:jpe?g|png|webp|tiff?|bmp|gif)$")
    rows = without_copies(files, folder, name).where(F.col(name).isNotNull()).withColumns({"imagenes": image, "unidad": F.when(image, F.lit("imagenes")).otherwise(F.concat(F.lit("f:"), F.col(name)))})
    return rows.groupBy(folder, "unidad", "imagenes").agg(F.count("*").alias("ficheros")).select(folder, "unidad", "ficheros", "imagenes")


#: Below these page counts a scan is a paper, and a legible text a chapter.
PAPER_PAGES, CHAPTER_PAGES = 12, 20


def by_pages(pages: Column, scanned: Column, kind: Column, doi: Column, strong: Column, several: Column) -> Column:
    """``tipo_recurso, formato`` that the number of pages asks for, null where it changes nothing; magazines and volumes stay as they are."""
    n = F.coalesce(pages, F.lit(0))
    free = (n > 0) & ~F.coalesce(several, F.lit(False)) & ~kind.eqNullSafe("revista")
    to = lambda kind, form: F.struct(F.lit(kind).alias("tipo_recurso"), F.lit(form).alias("formato"))
    scan = F.coalesce(scanned, F.lit(False))
    part = free & ~scan & (n < CHAPTER_PAGES) & ~F.coalesce(strong, F.lit(False)) & kind.eqNullSafe("libro")
    return F.when(free & scan & (n < PAPER_PAGES), to("libro", "papel")).when(part & ~absent(doi), to("articulo", None)).when(part, to("capitulo", None))


def activity(events: DataFrame, *, kinds: list[str] | None = None, user: str | None = None, pattern: str | None = None, nested: list[str] | None = None, since: str | None = None, until: str | None = None, at: str = "ts", kind_col: str = "tipo", user_col: str = "usuario") -> DataFrame:
    """Events of some kinds, of a user, with a text in one of some nested fields (case aside), between two times, both included."""
    rows = events
    if kinds:
        rows = rows.where(F.col(kind_col).isin(kinds))
    if user is not None:
        rows = rows.where(F.col(user_col) == user)
    if pattern:
        here = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(pattern.lower())), F.lit(False)) for c in nested or []]
        rows = rows.where(reduce(lambda a, b: a | b, here, F.lit(False)))
    if since:
        rows = rows.where(F.col(at) >= F.to_timestamp(F.lit(since)))
    return rows.where(F.col(at) <= F.to_timestamp(F.lit(until))) if until else rows
