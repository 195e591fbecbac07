"""Table functions for SQL: one text to many rows, by ``lateral``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from shelfspark.functions.blocks import parse_cip, valid_isbn
from shelfspark.functions.identifiers import ROLES, VOLUME_LABELS, WHOLE_WORK
from shelfspark.functions.text import fold
from shelfspark.shipping import shipped

_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _number(word: str) -> int | None:
    if word.isdecimal():
        return int(word)
    if not word or set(word) - set(_ROMAN):
        return None
    values = [_ROMAN[c] for c in word]
    return sum(-v if v < max(values[i + 1 :], default=0) else v for i, v in enumerate(values))


def role_of(label: str) -> tuple[str, int | None]:
    """What a label says of an ISBN, and the volume's number if it says that."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in fold(label)).split()
    said = f" {' '.join(words)} "
    if any(x in said for x in WHOLE_WORK):
        return "obra", None
    for word, after in zip(words, words[1:], strict=False):
        if word in VOLUME_LABELS and (n := _number(after)) is not None:
            return "volumen", n
    return next((role for role, known in ROLES.items() if any(x in said for x in known)), "desconocido"), None


@udtf(returnType=StructType([StructField("isbn", StringType()), StructField("role", StringType()), StructField("number", IntegerType()), StructField("label", StringType())]))
class IsbnRows:
    """Each ISBN of a text with a label in parentheses after it; a null text gives no rows."""

    def eval(self, text: str) -> Iterator[tuple]:
        pieces = (text or "").split("(")
        for before, after in zip(pieces, pieces[1:], strict=False):
            label, closed, _ = after.partition(")")
            run = before[len(before.rstrip("0123456789Xx- \t\n")) :]
            digits = "".join(c for c in run if c.isalnum())
            isbn = next((x for n in (13, 10) if len(digits) >= n and (x := valid_isbn(digits[-n:]))), None)
            if closed and isbn and 0 < len(label) <= 40:
                yield (isbn, *role_of(label), label.strip())


@udtf(returnType=StructType([StructField("kind", StringType()), StructField("at", IntegerType()), StructField("value", StringType()), StructField("label", StringType())]))
class CipRows:
    """Each statement of a cataloguing block: author, title, series, ISBNs, subjects, classes; a text without a block gives no rows."""

    def eval(self, text: str) -> Iterator[tuple]:
        found = parse_cip(text)
        if not found:
            return
        for kind in ("source", "author", "author_dates", "title", "subtitle", "series", "lc", "dewey", "lccn", "year"):
            if found.get(kind) is not None:
                yield kind, 0, str(found[kind]), None
        for i, x in enumerate(found["isbns"]):
            yield "isbn", i, x["isbn"], x["label"]
        for i, x in enumerate(found["subjects"]):
            yield "subject", i, x, None


def register(spark: SparkSession) -> None:
    """Make ``isbn_rows`` and ``cip_rows`` known to SQL: ``select … from t, lateral isbn_rows(t.text)``."""
    shipped(spark)
    spark.udtf.register("isbn_rows", IsbnRows)
    spark.udtf.register("cip_rows", CipRows)
