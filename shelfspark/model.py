"""Absence, collation and ordering rules that every later predicate builds on."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")


#: Combining marks, and the small letters of all scripts that are one letter with such marks; each folds to that letter.
MARKS = "".join(map(chr, range(0x300, 0x370)))
ACCENTED = "".join(c for c in map(chr, (*range(0xE0, 0x590), *range(0x1E00, 0x2000))) if c == c.lower() and unicodedata.category(c)[0] == "L" and _plain(c) != c and len(_plain(c)) == 1)
PLAIN = "".join(map(_plain, ACCENTED))
LAST_TEXT, LAST_NUMBER = "zzzzzzzz", 1e9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def absent(c: Column) -> Column:
    """Missing, null and empty are one; blanks are not trimmed."""
    return c.isNull() | (c == "")


def absent_array(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def ne_true(c: Column) -> Column:
    """Not true, which a missing value is."""
    return ~c.eqNullSafe(F.lit(True))


def not_in(c: Column, values: list) -> Column:
    """Outside ``values``, which a missing value is."""
    return c.isNull() | ~c.isin(*values)


def in_or_missing(c: Column, values: list) -> Column:
    return c.isNull() | c.isin(*values)


def contains(array: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def parse_int(c: Column) -> Column:
    """The whole number that a text begins with; null without one."""
    return F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long")


def number_key(c: Column) -> Column:
    """A number for sorting; what is none comes last."""
    return F.coalesce(c.try_cast("double"), F.lit(LAST_NUMBER))


def text_key(c: Column) -> Column:
    return F.when(absent(c), F.lit(LAST_TEXT)).otherwise(folded(c))


def folded(c: Column) -> Column:
    """Lower case without accents of any script, for comparison."""
    return F.translate(F.lower(c), ACCENTED + MARKS, PLAIN)  # marks beyond the plain letters are dropped


def fold(text: str) -> str:
    """What :func:`folded` makes of a text, for a query's own words."""
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN, MARKS))


def natural_key(c: Column) -> Column:
    """Order in which digit runs compare as numbers: before each, without leading zeros, stands its length in four places."""
    runs = F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.char_length(number(r)).cast("string"), 4, "0"), number(r))).otherwise(r)), "")


def first_valid(*columns: Column) -> Column:
    """The first value that is not blank after trimming."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))
