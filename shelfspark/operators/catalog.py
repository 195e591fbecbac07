"""The catalogue query: field grammar, filters, text match, order, grouping of works, paging."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.model import absent, absent_array, contains, folded, in_or_missing, natural_key, ne_true, number_key, text_key

#: Fields of the search grammar and the columns they look at.
FIELDS = {"titulo": ("titulo", "subtitulo", "titulo_original"), "autor": ("autores",), "editorial": ("editorial",), "idioma": ("idioma",), "cdu": ("cdu",), "coleccion": ("coleccion",), "isbn": ("isbn",), "issn": ("issn",), "lang": ("lang",), "source": ("source",)}


@dataclass(frozen=True)
class Term:
    field: str
    value: str
    negative: bool = False


def parse_fields(query: str, names: tuple[str, ...] = tuple(FIELDS)) -> tuple[list[Term], str]:
    """``campo:valor`` and ``-campo:valor`` terms, whose values run to the next field, and the free text before them."""
    marks = list(re.finditer(rf"(?<!\S)(-?)({'|'.join(map(re.escape, names))}):", query, re.IGNORECASE))
    free = query[: marks[0].start()].strip() if marks else query.strip()
    got: dict[tuple[str, bool], list[str]] = {}
    for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(query)], strict=False):
        value = query[m.end() : end].strip()
        if value:
            got.setdefault((m[2].lower(), m[1] == "-"), []).append(value)
    return [Term(f, " ".join(v), n) for (f, n), v in got.items()], free


def parse_keywords(query: str) -> list[str]:
    """``#word`` keywords; an underline stands for a blank, and a keyword runs to the next mark."""
    return [k.replace("_", " ").strip() for k in query.split("#")[1:] if k.replace("_", " ").strip()] if "#" in query else []


def field_condition(term: Term, columns: list[str]) -> Column:
    """The condition of one term; ``*`` asks that the field be there; a negated term also keeps missing values."""
    own = [F.col(c) for c in FIELDS.get(term.field, (term.field,)) if c in columns]
    if not own:
        cond = F.lit(False)
    elif term.value == "*":
        cond = ~absent(own[0].cast("string"))
    else:
        cond = F.lit(False)
        for c in own:
            cond = cond | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(term.value.lower())), F.lit(False))
    return ~F.coalesce(cond, F.lit(False)) if term.negative else cond


def identifier_condition(text: str, columns: list[Column]) -> Column | None:
    """For eight digits or more: any identifier that begins with them, separators aside."""
    digits = re.sub(r"[-\s]", "", text).upper()
    if not re.fullmatch(r"\d{8,}X?", digits):
        return None
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.upper(F.regexp_replace(c, r"[-\s]", "")).startswith(digits), F.lit(False))
    return cond


def substring_condition(text: str, columns: list[Column]) -> Column:
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return cond


def rating_condition(c: Column, wanted: list[int]) -> Column | None:
    """Several ratings at once; 0 is unrated, which a missing value is; all six are no condition."""
    if set(wanted) >= set(range(6)) or not wanted:
        return None
    rest = [w for w in wanted if w]
    return in_or_missing(c, wanted) if 0 in wanted else c.isin(*rest)


def day_condition(c: Column, day: str) -> Column:
    start = F.to_timestamp(F.lit(day))
    return (c >= start) & (c < start + F.expr("interval 1 day"))


def prefix_semi(codes: DataFrame, code: str, rows: DataFrame, long: str) -> DataFrame:
    """Codes that some row's longer code begins with, as an equi join on all prefixes of the distinct longer codes."""
    prefixes = rows.where(F.col(long).isNotNull()).select(F.col(long).alias("_l")).distinct()
    prefixes = prefixes.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("_l"), F.lit(1))), lambda n: F.call_function("left", F.col("_l"), n))).alias(code)).distinct()
    return codes.join(prefixes, code, "left_semi")


#: Named data-quality filters.
QUALITY: dict[str, Callable[[], Column]] = {
    "sin_isbn": lambda: F.col("tipo_recurso").eqNullSafe("libro") & absent(F.col("isbn")),
    "sin_autor": lambda: F.col("tipo_recurso").eqNullSafe("libro") & absent_array(F.col("autores")),
    "sin_hash": lambda: absent(F.col("hash_contenido")),
    "sin_portada": lambda: absent(F.col("portada")),
    "cdu_generica": lambda: F.col("cdu").isin("0", "00", "000"),
    "pendientes": lambda: F.col("estado_verificacion") == "pendiente",
    "sin_coleccion": lambda: absent(F.col("coleccion")),
    "revision": lambda: F.col("revision_requerida").eqNullSafe(True),
    "tomos_sin_numero": lambda: F.col("obra").isNotNull() & F.col("volumen_numero").isNull(),
}
#: Named filters on the work that a document is a volume of.
WORK_QUALITY: dict[str, Callable[[], Column]] = {
    "obras_incompletas": lambda: F.col("completa").eqNullSafe(False),
    "obras_revision": lambda: F.col("revision_requerida").eqNullSafe(True),
}


def of_quality(docs: DataFrame, name: str, works: DataFrame | None = None) -> DataFrame:
    """Documents of a named data-quality filter; those on works need the works."""
    if name in QUALITY:
        return docs.where(QUALITY[name]())
    return docs.join(works.where(WORK_QUALITY[name]()).select(F.col("_id").alias("obra")), "obra", "left_semi")


def visible_to_guests(docs: DataFrame, works: DataFrame, series: DataFrame) -> DataFrame:
    """Without rows marked as adult themselves or through their work or series."""
    hidden = lambda d, key: d.where(F.col("nsfw").eqNullSafe(True)).select(F.col("_id").alias(key))
    return docs.where(ne_true(docs["nsfw"])).join(hidden(works, "obra"), "obra", "left_anti").join(hidden(series, "coleccion"), "coleccion", "left_anti")


def order_keys(order: str, descending: bool = False, seed: int = 0) -> list[Column]:
    """Sort keys of an order keyword; missing keys come last by sentinels, and first when turned round, except pages."""
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    work = F.coalesce(F.col("obra"), F.col("_id"))
    keys = {
        "reciente": [F.col("fecha_ingreso").desc()],
        "antiguo": [F.col("fecha_ingreso").asc()],
        "fecha": [turn(number_key(F.col("anio_edicion"))), text_key(F.col("titulo"))],
        "titulo": [turn(text_key(F.col("titulo")))],
        "autor": [turn(text_key(F.col("primer_autor"))), text_key(F.col("titulo"))],
        "posicion": [turn(text_key(F.col("orden_estanteria")))],
        "obra": [turn(text_key(F.col("obra_titulo"))), number_key(F.col("volumen_numero"))],
        "coleccion": [turn(text_key(F.col("coleccion_nombre"))), number_key(F.col("coleccion_numero")), natural_key(F.col("clave_numero"))],
        "paginas": [(number_key(F.col("paginas")) == 1e9).asc(), turn(number_key(F.col("paginas")))],
        "azar": [F.xxhash64(F.concat(F.lit(f"{seed}:"), work)), work, number_key(F.col("volumen_numero"))],
    }
    return [*keys[order], F.col("_id").asc()]


def one_card_per_work(docs: DataFrame, keys: list[Column], work: Column, id_col: str = "_id") -> DataFrame:
    """The first row of each work in the given order, with ``n_volumes``.

    The rank alone lets every task drop all but a work's first rows before the shuffle, and the counts come from an
    aggregate, so a work that holds a third of the rows is not sorted in one task.
    """
    rows = docs.withColumn("_work", work)
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_work").orderBy(*keys))).where("_rank = 1").drop("_rank")
    counts = rows.groupBy(F.col("_work").alias("_w")).agg(F.count("*").alias("n_volumes"))
    return first.join(counts, F.col("_work").eqNullSafe(F.col("_w"))).drop("_w")


def page(docs: DataFrame, keys: list[Column], number: int = 1, size: int = 24) -> DataFrame:
    size = min(max(size, 1), 100)
    return docs.orderBy(*keys).offset((max(number, 1) - 1) * size).limit(size)


@dataclass
class CatalogQuery:
    """A catalogue request as one plan."""

    text: str = ""
    text_columns: tuple[str, ...] = ("titulo",)
    where: list[Column] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)
    work: Column | None = None
    page_number: int = 1
    page_size: int = 24

    def filtered(self, docs: DataFrame) -> DataFrame:
        terms, free = parse_fields(self.text)
        for t in terms:
            docs = docs.where(field_condition(t, docs.columns))
        for c in self.where:
            docs = docs.where(c)
        for token in re.findall(r"[^\W_]+", free.lower()):
            docs = docs.where(lax_token(token, self.text_columns))
        return docs

    def run(self, docs: DataFrame) -> DataFrame:
        rows = self.filtered(docs)
        if self.work is not None:
            rows = one_card_per_work(rows, self.order, self.work)
        return page(rows, self.order, self.page_number, self.page_size)


def lax_token(token: str, columns: tuple[str, ...]) -> Column:
    """Some word of some column begins with the token, accents aside."""
    word = folded(F.lit(token))
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.exists(F.regexp_extract_all(folded(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: w.startswith(word)), F.lit(False))
    return cond


def has_format(value: str) -> Column:
    return contains(F.col("formatos"), value)
