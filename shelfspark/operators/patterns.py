"""The pattern that the file names of a folder share, found by counts, and the fields that it gives.

Marks (ISBN, code and number at the beginning, year, brackets, month) are taken out of each name; what is left is cut by each
separator.  A folder's separator is the one that gives most names the same number of pieces; pieces are told apart by what most
of them look like.  Everything a folder's pattern needs is a count of its names, so a folder of any size is counted in parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.identifiers import isbn
from shelfspark.functions.names import MONTHS, any_of, is_author_artefact, is_title_artefact, month_number
from shelfspark.model import let
from shelfspark.operators.clusters import written

#: Separators with their weight, in order of preference among equals.
SEPARATORS = ((".", 3), (" - ", 4), (" — ", 4), (" · ", 4), ("·", 2), ("_", 1), ("-", 1), (" ", 0))
FIRST_YEAR, LAST_YEAR = 1400, 2099
_EDGE = r"[\s.,;:_·–—-]+"
_PUBLISHER = r"(?i)(?:^|[\s_])(?:UP|Press|Verlag|Editions?|Ediciones|Editorial|Books|Univ)\b"
_PERSON_WORD = r"\p{Lu}[\p{L}\p{N}_.'-]*"


def tidy(c: Column, underline_is_blank: Column) -> Column:
    """Blanks made one, marks at both ends gone."""
    t = F.regexp_replace(F.when(underline_is_blank, F.translate(c, "_", " ")).otherwise(c), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(t, "^" + _EDGE, ""), _EDGE + "$", "")


def _taken(state: Column, pattern: str, made: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """The state after a mark: fields of what the pattern finds in its rest, which loses the found text if the first field is there."""

    def cut(h: Column) -> Column:
        s, hit = h["s"], h["hit"]
        fields = made(s, hit)
        found = (hit != "") & next(iter(fields.values())).isNotNull()
        rest = F.concat(F.call_function("substring_index", s["rest"], hit, F.lit(1)), F.lit(" "), F.call_function("substring", s["rest"], F.call_function("locate", hit, s["rest"]) + F.char_length(hit)))
        out = s.withField("rest", F.when(found, rest).otherwise(s["rest"]))
        for k, v in fields.items():
            out = out.withField(k, F.when(found, v).otherwise(s[k]))
        return out

    return let(let(state, lambda s: F.struct(s.alias("s"), F.regexp_extract(s["rest"], pattern, 0).alias("hit"))), cut)


def marked(files: DataFrame, name: str = "nombre") -> DataFrame:
    """``files`` with ``isbn, code, number, year, brackets, month, rest`` of each name; null for a mark that isn't there."""
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    start = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.\s]{1,5}$", ""))
    state = F.struct(start.alias("rest"), none("string", "isbn"), none("string", "code"), none("int", "number"), none("int", "year"), none("string", "brackets"), none("int", "month"))
    edge = lambda body: rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"
    state = _taken(state, edge(r"97[89][\s-]?(?:\d[\s-]?){9}\d|(?:\d[\s-]?){9}[\dXx]"), lambda s, hit: {"isbn": isbn(hit)})
    state = _taken(state, r"^\s*[A-Za-z]{1,4}[\s_-]?\d{1,4}(?![\p{L}\p{N}_])", lambda s, hit: {"code": F.regexp_extract(hit, "[A-Za-z]+", 0), "number": F.regexp_extract(hit, r"\d+", 0).try_cast("int")})
    year = lambda hit: F.regexp_extract(hit, r"\d{4}", 0).try_cast("int")
    state = _taken(state, r"\((?:1[4-9]\d\d|20\d\d)\)", lambda s, hit: {"year": year(hit)})
    state = _taken(state, edge(r"1[4-9]\d\d|20\d\d"), lambda s, hit: {"year": F.when(s["year"].isNull(), year(hit))})
    state = _taken(state, r"\[[^\]]+\]", lambda s, hit: {"brackets": F.trim(F.regexp_replace(hit, r"[\[\]]", ""))})
    months = rf"(?i)(?<![\p{{L}}\p{{N}}]){any_of(tuple(MONTHS))}(?![\p{{L}}\p{{N}}])"
    state = _taken(state, months, lambda s, hit: {"month": month_number(hit)})
    out = files.withColumn("_m", state)
    return out.select(*files.columns, *(F.col(f"_m.{c}").alias(c) for c in ("isbn", "code", "number", "year", "brackets", "month")), tidy(F.col("_m.rest"), F.lit(False)).alias("rest"))


def pieces(rest: Column, separator: Column, underline_is_blank: Column) -> Column:
    """The pieces of what is left of a name; a dot before an underline is an initial's where underlines are blanks."""
    by = lambda s: F.when(F.lit(s == ".") & underline_is_blank, F.split(rest, r"\.(?!_)")).otherwise(F.split(rest, r"\s+" if s == " " else rf"\Q{s}\E"))
    cut = reduce(lambda other, s: F.when(separator == s, by(s)).otherwise(other), (s for s, _ in SEPARATORS), F.array(rest))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def separators(marks: DataFrame, folder: str) -> DataFrame:
    """``folder, n, blank, separator, pieces, share``: for each folder of two names or more the separator that cuts its names most alike.

    Of counts that are equally frequent the larger one is a separator's; of separators with equal score the first.
    """
    blank = marks.groupBy(folder).agg(F.count("*").alias("n"), (F.count_if(F.contains("rest", F.lit("_"))) * 2 >= F.count("*")).alias("blank")).where("n >= 2")
    rows = marks.join(blank, folder).where("rest <> ''")
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("separator"), F.lit(w).alias("w"), F.size(pieces(F.col("rest"), F.lit(s), F.col("blank"))).alias("k")) for i, (s, w) in enumerate(SEPARATORS)))
    counts = rows.select(folder, "n", "blank", F.explode(each).alias("x")).select(folder, "n", "blank", "x.*").where("k > 0 and not (blank and separator in ('_', ' '))")
    counts = counts.groupBy(folder, "n", "blank", "i", "separator", "w", "k").agg(F.count("*").alias("c"))
    mode = counts.groupBy(folder, "n", "blank", "i", "separator", "w").agg(F.max(F.struct("c", "k")).alias("m"), F.sum("c").alias("all"))
    score = F.col("m.c") / F.col("all") * 100 + F.col("w") * 3 + F.least(F.col("m.k"), F.lit(8))
    best = mode.where("m.k >= 2").groupBy(folder).agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("i")).alias("i"), "separator", F.col("m.k").alias("pieces"), (F.col("m.c") / F.col("all")).alias("share"))).alias("x"))
    return blank.join(best, folder, "left").select(folder, "n", "blank", F.col("x.separator").alias("separator"), F.coalesce("x.pieces", F.lit(1)).alias("pieces"), F.col("x.share").alias("share"))


def detected(files: DataFrame, folder: str = "carpeta", name: str = "nombre") -> DataFrame:
    """One pattern a folder: ``separator, blank, pieces``, which marks half of the names have, and ``fields``, what each piece is."""
    marks = written(marked(files.select(folder, name), name))
    cut = separators(marks, folder)
    flags = marks.groupBy(folder).agg(*((F.count(c) * 2 >= F.count("*")).alias(f"has_{c}") for c in ("isbn", "code", "number", "year", "month", "brackets")))
    rows = marks.join(cut, folder).withColumn("p", pieces(F.col("rest"), F.col("separator"), F.col("blank"))).where(F.size("p") == F.col("pieces"))
    each = rows.select(folder, F.posexplode("p").alias("at", "v"), "blank").withColumn("v", tidy(F.col("v"), F.col("blank"))).where("v <> ''")
    publisher, person = F.col("v").rlike(_PUBLISHER), F.col("v").rlike(rf"^{_PERSON_WORD}(?:[ _]{_PERSON_WORD}){{1,3}}$")
    looks = each.groupBy(folder, "at").agg((F.count_if(publisher) / F.count("*")).alias("p"), (F.count_if(person) / F.count("*")).alias("a"))
    kind = F.when(F.col("p") >= 0.5, "editorial").when(F.col("a") >= 0.6, "autor").otherwise("titulo")
    fields = looks.groupBy(folder).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", kind.alias("campo"))))).alias("fields"))
    return cut.join(flags, folder).join(fields, folder, "left")


def applied(files: DataFrame, patterns: DataFrame, folder: str = "carpeta", name: str = "nombre") -> DataFrame:
    """``files`` with the fields that their folder's pattern gives; what isn't plausible is left out."""
    rows = marked(files, name).join(written(patterns), folder, "left").withColumn("_p", pieces(F.col("rest"), F.col("separator"), F.coalesce("blank", F.lit(False))))
    said = F.coalesce("fields", F.create_map().cast("map<int,string>"))
    of = lambda field: F.filter(F.col("_p"), lambda x, i: F.coalesce(F.element_at(said, i), F.lit("")) == field)
    clean = lambda x: tidy(x, F.coalesce("blank", F.lit(False)))
    has = lambda c: F.when(F.coalesce(f"has_{c}", F.lit(False)), F.col(c))
    halves = F.split(F.get(of("titulo"), F.lit(0)), "_{2,}")
    good = lambda t: F.when((t != "") & ~is_title_artefact(t) & (F.regexp_count(t, F.lit(r"\p{L}")) >= 2), t)
    authors = F.filter(F.transform(of("autor"), clean), lambda a: (a != "") & ~is_author_artefact(a))
    rows = rows.withColumns({
        "titulo": good(clean(F.get(halves, F.lit(0)))), "subtitulo": good(clean(F.get(halves, F.lit(1)))), "autores": F.when(F.size(authors) > 0, authors), "editorial": F.nullif(clean(F.get(of("editorial"), F.lit(0))), F.lit("")),
        "isbn": has("isbn"), "anio_edicion": F.when(F.col("year").between(FIRST_YEAR, LAST_YEAR), has("year")), "mes_publicacion": has("month"), "coleccion_nombre": has("code"), "coleccion_numero": F.when(F.col("has_code"), has("number")),
    })
    own = ["titulo", "subtitulo", "autores", "editorial", "isbn", "anio_edicion", "mes_publicacion", "coleccion_nombre", "coleccion_numero"]
    return rows.select(*[c for c in files.columns if c not in own], *own)
