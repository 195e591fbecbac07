"""MARC 21 records as XML text, from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.model import absent


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def field(tag: str, value: Column, code: str = "a", first: str = " ", second: str = " ") -> Column:
    """A data field with one subfield; nothing for an absent value."""
    text = F.concat(F.lit(f'<datafield tag="{tag}" ind1="{first}" ind2="{second}"><subfield code="{code}">'), escaped(value), F.lit("</subfield></datafield>"))
    return F.when(absent(value), F.lit("")).otherwise(text)


def fields(tag: str, values: Column, code: str = "a", first: str = " ", second: str = " ") -> Column:
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: field(tag, v, code, first, second)), "")


def record(c: dict[str, Column]) -> Column:
    """A record of the given columns: isbn, issn, udc, author, title, publisher, year, pages, subjects, summary, url."""
    get = lambda k: c.get(k, F.lit(None)).cast("string")
    year = F.rpad(F.coalesce(get("year"), F.lit("||||")), 4, "|")
    control = F.concat(F.lit('<controlfield tag="008">------s'), year, F.lit("----xx |||||||||||||||||||"), F.rpad(F.coalesce(get("language"), F.lit("und")), 3, " "), F.lit("||</controlfield>"))
    parts = [F.lit('<record xmlns="http://www.loc.gov/MARC21/slim"><leader>00000nam a2200000   4500</leader>'), control]
    parts += [field("020", get("isbn")), field("022", get("issn")), field("080", get("udc")), field("100", get("author"), first="1"), field("245", get("title"), first="1", second="0")]
    parts += [field("264", get("publisher"), "b", second="1"), field("300", get("pages")), fields("650", c.get("subjects", F.lit(None).cast("array<string>")), second="4"), field("520", get("summary")), field("856", get("url"), "u", first="4")]
    return F.concat(*parts, F.lit("</record>"))
