"""Roman and arabic numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def to_arabic(c: Column) -> Column:
    """A whole number from up to four digits or up to seven roman ones; null otherwise."""
    t = F.upper(F.trim(c))
    value = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    values = F.transform(F.split(t, ""), lambda d: F.coalesce(F.element_at(value, d), F.lit(0)))
    total = F.aggregate(F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return F.when(t.rlike(r"^\d{1,4}$"), t.try_cast("int")).when(t.rlike(r"^[IVXLCDM]{1,7}$"), total)
