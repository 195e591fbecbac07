"""Text conditions on rows themselves, for tables without an index; searches of an index are in ``index``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.operators.index import tokens


def phrase(c: Column, query: str) -> Column:
    """The query's words side by side in one column."""
    pad = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return (F.size(tokens(F.lit(query))) > 0) & F.contains(pad(tokens(c)), pad(tokens(F.lit(query))))
