"""Cataloguing-in-publication blocks and file names, parsed in Python and offered as vectorised functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from shelfspark.functions.names import AUTHOR_PROGRAMS, DOMAINS, MONTHS, PROSE

#: The headings that open a block, and the source that each names.
HEADINGS = (
    ("cip-lc", r"library of congress cataloging[- ]?in[- ]?publication"),
    ("cip-bl", r"british library cataloguing[- ]?in[- ]?publication"),
    ("cip-lc", r"cataloging[- ]?in[- ]?publication data"),
    ("cip-es", r"catalogaci[óo]n en (?:la )?publicaci[óo]n|datos de catalogaci[óo]n"),
)
#: A block is short; what lies further on is the book.
BLOCK_CHARS = 1500
_TEXT, _INT = StringType(), IntegerType()
CIP = StructType(
    [StructField(n, _TEXT) for n in ("source", "author", "author_dates", "title", "subtitle", "series")]
    + [StructField("isbns", ArrayType(StructType([StructField("isbn", _TEXT), StructField("label", _TEXT)]))), StructField("subjects", ArrayType(_TEXT))]
    + [StructField(n, _TEXT) for n in ("lc", "dewey", "lccn")]
    + [StructField("year", _INT)]
)
FILE_NAME = StructType([StructField(n, _TEXT) for n in ("isbn", "title", "author", "series", "number", "publisher")] + [StructField("year", _INT), StructField("month", _INT)])


def valid_isbn(s: str) -> str | None:
    n = re.sub(r"[\s-]", "", s).upper()
    if re.fullmatch(r"\d{13}", n):
        return n if sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(n)) % 10 == 0 else None
    if re.fullmatch(r"\d{9}[\dX]", n):
        return n if sum((10 if c == "X" else int(c)) * (10 - i) for i, c in enumerate(n)) % 11 == 0 else None
    return None


def parse_cip(text: str | None) -> dict | None:
    """What a block states, or None if the text has none."""
    hit = next(((source, m) for source, p in HEADINGS if (m := re.search(p, text or "", re.I))), None)
    if hit is None:
        return None
    source, mark = hit
    block = text[mark.start() : mark.start() + BLOCK_CHARS]
    dashed = re.sub("[‐-―−]", "-", block)
    lines = [x.strip() for x in block.splitlines()[1:] if x.strip()]
    out = dict.fromkeys([f.name for f in CIP.fields]) | {"source": source, "isbns": [], "subjects": []}
    person = next((m for x in lines[:2] if (m := re.fullmatch(r"(\D+?,\s[^,\d]+?)(?:,\s*(\d{4}\s*[-‐-―]\s*(?:\d{4})?))?\.?", x))), None) if lines else None
    if person:
        out["author"], out["author_dates"] = person[1].strip(), person[2]
        if out["author"].count(".") == 0 and not person[2]:
            out["author"] = out["author"].rstrip(".")
    stated = next((x for x in lines if " / " in x), None)
    if stated:
        title, _, rest = stated.split(" / ")[0].partition(" : ")
        out["title"], out["subtitle"] = title.strip(), rest.strip() or None
    series = re.search(r"\bcm\.?\s*[-—–]+\s*\(([^()]+(?:\([^()]*\))?[^()]*)\)", block)
    out["series"] = series[1].strip() if series else None
    for m in re.finditer(r"ISBN[-\d:]*?\s*((?:\d[\s-]?){9,12}[\dXx])\s*(?:\(([^)]*)\))?", dashed):
        isbn = valid_isbn(m[1])
        if isbn:
            out["isbns"].append({"isbn": isbn, "label": (m[2] or "").strip() or None})
    body = re.search(r"(?<![\w.])1\.\s.*?(?=\s+I\.\s|\n[A-Z]{1,3}\d|\Z)", block, re.S)
    if body:
        flat = re.sub(r"\s+", " ", body[0])
        out["subjects"] = [s.strip().rstrip(".") for s in re.split(r"(?:^|(?<=[\s.)]))\d{1,2}\.\s", flat) if s.strip()]
    lc = re.search(r"^([A-Z]{1,3}\d+(?:\.\d+)?(?:\s?\.[A-Z]\d+)*)(?:\s+(\d{4}))?", "\n".join(lines), re.M)
    if lc:
        out["lc"], out["year"] = lc[1], int(lc[2]) if lc[2] else None
    dewey = re.search(r"\b(\d{3}(?:['’]?\.\d+)?['’]?)\s*[-—–]*\s*d?dc\s?\d{2}", dashed)
    out["dewey"] = re.sub("['’]", "", dewey[1]) if dewey else None
    lccn = re.search(r"dc\s?\d{2}\s+(\d{8,10}|\d{2}-\d{4,6})\b", dashed)
    out["lccn"] = lccn[1] if lccn else None
    return out


def _may_be_person(p: str) -> bool:
    """A few words with letters, none of prose, a program or a web address."""
    words = p.lower().split()
    ends = {w.rpartition(".")[2] for w in words if "." in w.rstrip(".")}
    return any(c.isalpha() for c in p) and len(words) < 8 and not (len(words) > 2 and set(words) & set(PROSE)) and not ends & set(DOMAINS) and not any(x in p.lower() for x in AUTHOR_PROGRAMS)


def parse_file_name(name: str | None) -> dict | None:
    """ISBN, title, author, series, number, year and month of a file's name, by the first form that fits."""
    if not name or not name.strip():
        return None
    base = re.sub(r"\.[A-Za-z0-9]{2,4}$", "", name.strip())
    out = dict.fromkeys([f.name for f in FILE_NAME.fields])
    isbn = valid_isbn(base)
    if isbn:
        return out | {"isbn": isbn}
    base, marks, author_first = _bracketed_heads(base)
    out |= marks
    if author_first:
        who, dash, what = base.partition(" - ")
        people = [p.strip() for p in who.split("&") if _may_be_person(p)]
        return out | ({"author": " & ".join(people) or None, "title": what.strip()} if dash else {"title": base})
    bracketed = re.fullmatch(r"(.+?)\s*\[(.+?)\s+(\d+)\]\s*(.*)", base)
    if bracketed:  # Author [Series N] Title
        return out | {"author": bracketed[1].strip(" -"), "series": bracketed[2], "number": bracketed[3], "title": bracketed[4].strip(" -") or None}
    dated = re.fullmatch(r"(?:(.*?)[\s_-]+)?((?:19|20)\d{2})-(0[1-9]|1[0-2])(?:-\d{2})?(?:[\s_-]+(.*))?", base)
    if dated and (dated[1] or dated[4]):
        return out | {"title": (dated[1] or dated[4]).strip(), "year": int(dated[2]), "month": int(dated[3])}
    named = re.fullmatch(rf"(.*?)[\s_,-]+({'|'.join(MONTHS)})\.?[\s_,-]+(?:de\s+)?((?:19|20)\d{{2}})", base, re.I)
    if named:
        return out | {"title": named[1].strip(), "month": MONTHS[named[2].lower()], "year": int(named[3])}
    parts = re.split(r"\s+-\s+", base)
    if len(parts) == 2 and all(p.strip() for p in parts):
        return out | {"title": parts[0].strip(), "author": parts[1].strip()}
    return out | {"title": re.sub(r"[_.]+", " ", base).strip() if " " not in base else base}


def _bracketed_heads(name: str) -> tuple[str, dict, bool]:
    """A name without the brackets at its head, what those say, and whether the author comes first.

    A numbered bracket is a series, another one the publisher.  A revision mark such as ``[1234] (r1.2)`` at the end, or a
    series, tell the form "Author & Author - Title".
    """
    rest = re.sub(r"\s*(?:\[\d+\]\s*)?\(r[\d.]+\)\s*$", "", name, flags=re.I)
    first, marks = rest != name, {}
    while head := re.match(r"\s*\[([^\]]+)\]\s*", rest):
        label, _, last = re.sub(r"\s+_\s+", " & ", head[1].strip()).rpartition(" ")
        if label.strip() and re.fullmatch(r"\d{1,4}|[IVXLCDM]{1,7}", last):
            marks |= {"series": label.strip(), "number": last}
            first = True
        else:
            marks.setdefault("publisher", f"{label} {last}".strip())
        rest = rest[head.end() :]
    rest = re.sub(r"\s*\[\d+\]\s*$", "", rest) if first else rest
    return (rest.strip(), marks, first) if rest.strip() else (name, {}, False)


@F.pandas_udf(CIP)
def cip_udf(s: pd.Series) -> pd.DataFrame:
    return _frame(s, parse_cip, CIP)


@F.pandas_udf(FILE_NAME)
def file_name_udf(s: pd.Series) -> pd.DataFrame:
    return _frame(s, parse_file_name, FILE_NAME)


def _frame(s: pd.Series, f, kind: StructType) -> pd.DataFrame:
    """One row a text; a text without a result has only nulls."""
    empty = dict.fromkeys([x.name for x in kind.fields])
    return pd.DataFrame([f(x) or empty for x in s], columns=list(empty), dtype=object)
