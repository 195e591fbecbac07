"""UDC codes, crosswalks, resource types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCLASSED = "_sin_clasificar"
#: Dewey hundreds and tens with an unambiguous UDC place.
DEWEY_TO_UDC = {
    "000": "0", "010": "01", "020": "02", "030": "03", "050": "05", "060": "06", "070": "07", "080": "08", "090": "09",
    "100": "1", "110": "11", "140": "14", "160": "16", "170": "17", "200": "2", "220": "22", "230": "23", "290": "29",
    "300": "3", "310": "31", "320": "32", "330": "33", "340": "34", "350": "35", "360": "36", "370": "37", "390": "39",
    "900": "9", "910": "91", "920": "929",
}
#: Library of Congress classes of science and technology with their UDC place.
LCC_TO_UDC = {"Q": "5", "QA": "51", "QB": "52", "QC": "53", "QD": "54", "QE": "55", "QH": "57", "QK": "58", "QL": "59", "R": "61", "S": "63", "T": "6"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


#: What a path can't hold, and what stands for it (the rest goes).
FORBIDDEN, STAND_INS = ':"<>/\\|?*', "__"
#: How deep brackets of a code may lie in each other.
NESTED = 8


def udc_clean(c: Column) -> Column:
    """A UDC code fit for a path of at most 60 characters.

    The code is the first word and those after it that begin with no letter.  Pairs of brackets are marked from the inside
    out; the code ends before the first bracket that is never closed.
    """
    words = F.split(F.trim(F.coalesce(c, F.lit(""))), r"[\s\x00-\x1f]+")
    begins = F.transform(words, lambda w, i: (i > 0) & w.rlike(r"^\p{L}"))
    kept = F.when(F.array_contains(begins, True), F.slice(words, 1, F.array_position(begins, True).cast("int") - 1)).otherwise(words)
    code = F.array_join(F.split(F.translate(F.array_join(kept, ""), FORBIDDEN, STAND_INS), "_+"), "_")
    for _ in range(NESTED):
        code = F.regexp_replace(code, r"\(([^()]*)\)", "\u0002$1\u0003")
    whole = F.translate(F.call_function("substring_index", code, F.lit("("), F.lit(1)), "\u0002\u0003", "()")
    return F.substring(F.rtrim(F.ltrim(whole, F.lit("._-")), F.lit("._-(")), 1, 60)


def udc_tree(c: Column) -> Column:
    """``class, division, leaf``; a code without a leading digit is unclassed."""
    leaf = udc_clean(c)
    digits = F.regexp_extract(leaf, "^[0-9]+", 0)
    known = digits != ""
    return F.struct(
        F.when(known, F.substring(digits, 1, 1)).otherwise(UNCLASSED).alias("class"),
        F.when(known, F.substring(digits, 1, 3)).otherwise(UNCLASSED).alias("division"),
        F.when(leaf != "", leaf).otherwise(UNCLASSED).alias("leaf"),
    )


def dewey_to_udc(c: Column) -> Column:
    d = F.regexp_extract(F.coalesce(c, F.lit("")), r"\d{3}", 0)
    tens = F.when(F.substring(d, 2, 1) != "0", F.substring(d, 1, 2)).otherwise(F.substring(d, 1, 1))
    return F.when(d == "", None).when(d.isin("004", "005", "006"), "004").when(F.substring(d, 1, 1).isin("5", "6", "7"), tens).otherwise(F.element_at(_map(DEWEY_TO_UDC), d))


def lcc_to_udc(c: Column) -> Column:
    letters = F.regexp_extract(F.upper(F.trim(F.coalesce(c, F.lit("")))), "^[A-Z]{1,3}", 0)
    return F.coalesce(F.element_at(_map(LCC_TO_UDC), F.substring(letters, 1, 2)), F.element_at(_map(LCC_TO_UDC), F.substring(letters, 1, 1)))


#: Words of subjects that tell literature, and extensions of sound files.
FICTION = ("ficción", "fiction", "literatura", "literature", "novel", "poesía", "poetry", "drama", "cuentos", "relatos")
AUDIO = ("mp3", "m4a", "m4b", "m4p", "aac", "ogg", "oga", "opus", "flac", "wav", "wma", "aax", "aa", "ape", "alac", "aiff", "aif", "mka", "wv")


def is_fiction(dewey: Column, lcc: Column, subjects: Column) -> Column:
    """Dewey 8, a two-letter LCC class of P, or a subject that names literature; what is missing says nothing."""
    told = F.lower(F.array_join(F.coalesce(subjects, F.array().cast("array<string>")), "\n"))
    named = F.exists(F.array(*map(F.lit, FICTION)), lambda w: F.contains(told, w))
    return F.coalesce(F.trim(dewey).startswith("8"), F.lit(False)) | F.coalesce(F.trim(lcc).rlike("^P[A-Z]"), F.lit(False)) | named


def resource_type(s: dict[str, Column]) -> Column:
    """``libro``, ``revista`` or ``articulo`` from signals, strongest first; a signal that is not given is false."""
    on = lambda k: F.coalesce(s.get(k, F.lit(False)), F.lit(False))
    serial = (on("comic_number") | on("dated") | on("strong_issn")) & ~on("own_isbn")
    book = on("own_isbn") | on("cip") | on("book_series") | on("book_publisher")
    return (
        F.when(on("comic"), F.when(serial, "revista").otherwise("libro"))
        .when(on("multipart"), "libro").when(on("article_doi"), "articulo").when(book, "libro")
        .when(on("dated") | on("strong_issn"), "revista").when(on("magazine_look") | on("issn_hint"), "revista").otherwise("libro")
    )


def file_format(path: Column) -> Column:
    """What a file's extension says it is."""
    e = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return (
        F.when(e == "epub", "epub").when(e == "pdf", "pdf").when(e.isin("jpg", "jpeg", "png", "webp", "gif", "tif", "tiff", "bmp"), "imagen")
        .when(e.isin("cbz", "cbr", "cb7"), "comic").when(e.isin("djvu", "djv"), "djvu").when(e == "chm", "chm").when(e.isin("doc", "docx", "rtf", "odt"), "word")
        .when(e.isin("mobi", "azw", "azw3", "fb2"), "mobi").when(e.isin(*AUDIO), "audio").when(e == "", "desconocido").otherwise("otro")
    )
