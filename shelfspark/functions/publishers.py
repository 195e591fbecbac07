"""Publishers that are none, and how publishers compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.model import folded

#: Who packs or reissues books without being a publisher, without blanks and marks.
PACKERS = ("epublibre", "lectulandia", "ozepub", "todoepub", "epubgratis", "digicat", "goodpress", "eartnow", "musaicum", "createspace", "independentlypublished", "kindledirect")
#: The same, where the whole word counts.
PACKER_WORDS = ("kdp", "lulu")
#: Words that say that something is a publisher, not which one.
PUBLISHER_WORDS = ("editorial", "ediciones", "edicions", "editions", "edition", "editores", "editor", "ed", "eds", "publishing", "publishers", "publisher", "press", "verlag", "books", "libros", "grupo", "group", "inc", "ltd", "sa", "sl", "sau", "co", "the")


def is_false_publisher(c: Column) -> Column:
    """A packer or reissuer instead of a publisher; an absent name is none."""
    plain = folded(F.coalesce(c, F.lit("")))
    compact = F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "")
    return F.exists(F.array(*map(F.lit, PACKERS)), lambda p: F.contains(compact, p)) | F.arrays_overlap(F.split(plain, r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, PACKER_WORDS)))


def publisher_key(c: Column) -> Column:
    """A publisher's own words, sorted, without accents and without words that all publishers share; null if none is left."""
    words = F.filter(F.split(folded(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*PUBLISHER_WORDS))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(words)), " "), F.lit(""))
