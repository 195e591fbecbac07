"""A whole catalogue request over documents, people, publishers, works, series, selections and a text index.

Filters on columns are predicates on the documents; what needs another table (names, works, series, selections) is a semi or
anti join of ids, never a list in the driver.  Free text finds documents through the index, other spellings, identifiers and
DOIs together; a text that finds nothing gives no documents, and an empty one doesn't filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.identifiers import doi_in, isbn_variants, issn
from shelfspark.model import LAST_NUMBER, absent, absent_array, contains, natural_key, ne_true, number_key, text_key
from shelfspark.operators.catalog import identifier_condition, of_quality, one_card_per_work, parse_fields, parse_keywords, rating_condition, substring_condition, visible_to_guests
from shelfspark.operators.index import TextIndex

#: Names of the search grammar's fields, types, formats, kinds of comics.
FIELD_NAMES = {
    "titulo": "titulo", "título": "titulo", "title": "titulo", "autor": "autor", "autores": "autor", "author": "autor", "editorial": "editorial", "publisher": "editorial",
    "subtitulo": "subtitulo", "subtítulo": "subtitulo", "coleccion": "coleccion", "colección": "coleccion", "serie": "coleccion", "isbn": "isbn", "issn": "issn",
}
TYPES = ("libro", "revista", "articulo", "apuntes", "capitulo", "software")
FORMATS = ("pdf", "epub", "mobi", "cbz", "cbr", "cb7", "djvu", "audio", "video", "papel")
COMICS = ("comic", "novela-grafica")


@dataclass(frozen=True)
class Catalogue:
    """The tables that a request reads; those that it doesn't need may be missing."""

    docs: DataFrame
    authors: DataFrame | None = None
    publishers: DataFrame | None = None
    works: DataFrame | None = None
    series: DataFrame | None = None
    selections: DataFrame | None = None
    index: TextIndex | None = None


def named(people: DataFrame, text: str, alternatives_only: bool = False) -> DataFrame:
    """``_id`` of those whose name or other spelling holds the text, case aside."""
    here = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    other = F.exists(F.coalesce("nombres_alternativos", F.array().cast("array<string>")), here)
    return people.where(F.coalesce(other if alternatives_only else here(F.col("nombre")) | other, F.lit(False))).select("_id")


def of_people(docs: DataFrame, people: DataFrame) -> DataFrame:
    """``_id`` of the documents with one of the people as an author."""
    flat = docs.select("_id", F.explode("autores").alias("_p"))
    return flat.join(people.select(F.col("_id").alias("_p")), "_p", "left_semi").select("_id").distinct()


@dataclass
class Request:
    """One catalogue request; every part that is not set is no condition."""

    q: str = ""
    tipo: str = ""
    soporte: str = ""
    formato: str = ""
    ambito: str = ""
    estanteria: str = ""
    cdu: str = ""
    cdu_exacto: bool = False
    clasificacion: tuple[str, str] | None = None
    dia: str = ""
    filtro: str = ""
    estrellas: list[int] = field(default_factory=list)
    leido: list[int] = field(default_factory=list)
    like: str = ""
    nsfw: str = ""
    nfc: str = ""
    autor: str = ""
    editorial: str = ""
    ids: DataFrame | None = None
    colecciones: list[str] = field(default_factory=list)
    obras: list[str] = field(default_factory=list)
    seleccion: str = ""
    invitado: bool = False
    estricto: bool = False
    orden: str = "reciente"
    dir: str = ""
    seed: str = "1"
    agrupar: bool = True
    pagina: int = 1
    por_pagina: int = 24

    def predicates(self) -> list[Column]:
        """Conditions on a document's own columns."""
        out: list[Column | None] = []
        if self.tipo in TYPES:
            out.append(F.col("tipo_recurso") == self.tipo)
        elif self.tipo == "comic":
            out.append(F.col("naturaleza").isin(*COMICS))
        if self.formato.lower() in FORMATS:  # a format goes before paper or digital
            out.append(contains(F.col("formatos"), self.formato.lower()))
        elif self.soporte in ("papel", "digital"):
            paper = contains(F.col("formatos"), "papel")
            out.append(paper if self.soporte == "papel" else ~paper)
        if self.ambito:  # a shelf counts only inside its area
            out.append(F.col("ubicacion.ambito") == self.ambito)
            out.append(F.col("ubicacion.estanteria") == self.estanteria if self.estanteria else None)
        if self.cdu:
            out.append(F.col("cdu") == self.cdu if self.cdu_exacto else F.col("cdu").startswith(self.cdu))
        if self.clasificacion and self.clasificacion[0] in ("cdu", "dewey", "lcc") and self.clasificacion[1]:
            out.append(F.col(self.clasificacion[0]) == self.clasificacion[1])
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", self.dia):
            start = F.to_timestamp(F.lit(self.dia))
            out.append((F.col("fecha_ingreso") >= start) & (F.col("fecha_ingreso") < start + F.expr("interval 1 day")))
        for column, wanted in (("valoracion", self.estrellas), ("leido", self.leido)):
            out.append(rating_condition(F.col(column), wanted) if wanted else None)
        if self.like in ("up", "down"):
            out.append(F.col("like") == self.like)
        elif self.like == "sin":
            out.append(F.col("like").isNull())
        if self.nsfw in ("solo", "excluir"):
            out.append(F.col("nsfw").eqNullSafe(True) if self.nsfw == "solo" else ne_true(F.col("nsfw")))
        if self.nfc in ("con", "sin"):
            out.append(F.col("nfc.fecha_vinculacion").isNotNull() if self.nfc == "con" else F.col("nfc.fecha_vinculacion").isNull())
        if self.autor:
            person = F.exists("contribuciones", lambda x: x["persona"] == self.autor)
            out.append(contains(F.col("autores"), self.autor) | F.coalesce(person, F.lit(False)))
        if self.editorial:
            out.append(F.col("editorial") == self.editorial)
        if self.colecciones:
            out.append(F.col("coleccion").isin(self.colecciones))
        if self.obras:
            out.append(F.col("obra").isin(self.obras))
        return [c for c in out if c is not None]

    def _of_field(self, cat: Catalogue, name: str, value: str) -> Column | DataFrame:
        """What a ``campo:valor`` asks for: a condition, or the ids of the documents."""
        if value == "*":
            return {"autor": ~absent_array(F.col("autores")), "editorial": F.col("editorial").isNotNull(), "coleccion": F.col("coleccion").isNotNull()}.get(name, ~absent(F.col(name)))
        if name == "autor":
            return of_people(cat.docs, named(cat.authors, value))
        if name == "editorial":
            return cat.docs.select("_id", F.col("editorial").alias("_p")).join(named(cat.publishers, value).select(F.col("_id").alias("_p")), "_p", "left_semi").select("_id")
        if name == "isbn":
            digits = re.sub(r"[^0-9Xx]", "", value)
            forms = isbn_variants(F.lit(value))
            return F.when(F.size(forms) > 0, F.array_contains(forms, F.col("isbn"))).otherwise(F.contains(F.lower("isbn"), F.lit(digits.lower())))
        if name == "issn":
            return F.coalesce(F.col("issn") == issn(F.lit(value)), F.contains(F.lower("issn"), F.lit(re.sub(r"[^0-9Xx-]", "", value).lower())))
        columns = {"titulo": ("titulo", "titulo_original", "obra_titulo"), "subtitulo": ("subtitulo",), "coleccion": ("coleccion_nombre",)}[name]
        return substring_condition(value, [F.col(c) for c in columns])

    def _by_text(self, cat: Catalogue, text: str) -> DataFrame:
        """``_id, _score`` of what a free text finds: null scores come last in order of relevance."""
        docs, found = cat.docs, []
        plain = lambda rows: rows.select("_id", F.lit(None).cast("double").alias("_score"))
        if text.lstrip().startswith("#"):
            keywords = parse_keywords(text)
            if cat.index is None:
                same = lambda k: F.exists("palabras_clave", lambda x: F.contains(F.lower(x), F.lit(k.lower())))
                return plain(docs.where(reduce(lambda a, b: a | b, (F.coalesce(same(k), F.lit(False)) for k in keywords), F.lit(False))))
            ranked = cat.index.keywords(keywords, "palabras_clave")
            return ranked.select(F.col("id").alias("_id"), (F.col("hits") * F.lit(LAST_NUMBER) - F.col("best")).alias("_score"))
        if cat.index is not None:
            hits = cat.index.phrase(text) if self.estricto else cat.index.search(text)
            found.append(hits.select(F.col("id").alias("_id"), F.col("score").alias("_score")))
        else:  # no index: substrings
            own = ("titulo", "titulo_original", "subtitulo", "obra_titulo", "coleccion_nombre", "nombre_archivo")
            inside = lambda c: F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), F.lit(text.lower()))), F.lit(False))
            found.append(plain(docs.where(substring_condition(text, [F.col(c) for c in own]) | inside("titulos_originales") | inside("palabras_clave"))))
        if cat.index is None or len(text) >= 3:
            only = cat.index is not None  # the index holds the first spellings
            if cat.authors is not None:
                found.append(plain(of_people(docs, named(cat.authors, text, only))))
            if cat.publishers is not None:
                found.append(plain(docs.join(named(cat.publishers, text, only).select(F.col("_id").alias("editorial")), "editorial", "left_semi")))
        digits = re.sub(r"[^0-9Xx]", "", text)
        if len(digits) >= 8:
            begins = lambda c: F.coalesce(F.upper(F.regexp_replace(c, r"[-\s]", "")).startswith(digits.upper()), F.lit(False))
            other = F.coalesce(F.exists("isbns_alternativos", lambda x: begins(x["isbn"])), F.lit(False))
            found.append(plain(docs.where(begins(F.col("isbn")) | begins(F.col("issn")) | begins(F.col("isbn_obra")) | other)))
            if cat.series is not None:
                found.append(plain(docs.join(cat.series.where(begins(F.col("issn"))).select(F.col("_id").alias("coleccion")), "coleccion", "left_semi")))
        if "10." in text:
            found.append(plain(docs.where(F.col("doi") == doi_in(F.lit(text)))))
        return reduce(DataFrame.unionByName, found).groupBy("_id").agg(F.max("_score").alias("_score"))

    def matching(self, cat: Catalogue) -> DataFrame:
        """The documents of the request, all columns; with a text also ``_score``."""
        rows, free = cat.docs, self.q.strip()
        if not free.startswith("#"):
            terms, free = parse_fields(free, tuple(FIELD_NAMES))
            merged: dict[tuple[str, bool], str] = {}
            for t in terms:
                key = (FIELD_NAMES[t.field], t.negative)
                merged[key] = f"{merged[key]} {t.value}" if key in merged else t.value
            for (name, negative), value in merged.items():
                asked = self._of_field(cat, name, value)
                if isinstance(asked, DataFrame):
                    rows = rows.join(asked, "_id", "left_anti" if negative else "left_semi")
                else:
                    rows = rows.where(~F.coalesce(asked, F.lit(False)) if negative else asked)
        for c in self.predicates():
            rows = rows.where(c)
        if self.filtro:
            rows = of_quality(rows, self.filtro, cat.works)
        if self.ids is not None:
            rows = rows.join(self.ids.select("_id"), "_id", "left_semi")
        if self.seleccion:
            rows = rows.join(cat.selections.where(F.col("_id") == self.seleccion).select(F.explode("docs").alias("_id")), "_id", "left_semi")
        if self.invitado:
            rows = visible_to_guests(rows, cat.works, cat.series)
        return rows.join(self._by_text(cat, free), "_id") if free else rows

    def keys(self, cat: Catalogue, rows: DataFrame) -> tuple[DataFrame, list[Column]]:
        """The rows with what their order needs, and the sort keys; ties go by id, so pages never overlap."""
        if self.orden in ("reciente", "") and "_score" in rows.columns:
            return rows, [F.desc_nulls_last("_score"), F.desc("fecha_ingreso"), F.asc("_id")]
        down = {"asc": False, "desc": True}.get(self.dir.lower(), self.orden not in ("antiguo", "titulo", "autor", "posicion", "obra", "coleccion", "paginas", "azar"))
        turn = lambda c: c.desc() if down else c.asc()
        title = text_key(F.col("titulo"))
        if self.orden == "autor":
            first = F.get("autores", F.lit(0))
            rows = rows.withColumn("_first", first).join(cat.authors.select(F.col("_id").alias("_first"), F.col("nombre").alias("_name")), "_first", "left")
            return rows, [turn(text_key(F.col("_name"))), title, F.asc("_id")]
        keys = {
            "titulo": lambda: [turn(title)],
            "posicion": lambda: [turn(text_key(F.col("ubicacion.ambito"))), turn(text_key(F.col("ubicacion.estanteria"))), turn(number_key(F.col("orden_estanteria"))), title],
            "obra": lambda: [turn(text_key(F.col("obra_titulo"))), turn(number_key(F.col("volumen_numero"))), title],
            "coleccion": lambda: [turn(text_key(F.col("coleccion_nombre"))), turn(number_key(F.col("coleccion_numero"))), title],
            "paginas": lambda: [(F.coalesce(F.col("paginas").try_cast("double"), F.lit(0.0)) <= 0).asc(), turn(F.coalesce(F.col("paginas").try_cast("double"), F.lit(0.0))), title],
            "azar": lambda: [F.xxhash64(F.concat(F.lit(re.sub(r"[^0-9A-Za-z_-]", "", self.seed)[:40] or "1"), F.lit(":"), F.coalesce("obra", "_id"))), F.coalesce("obra", "_id"), number_key(F.col("volumen_numero"))],
        }
        own = keys.get(self.orden, lambda: [turn(F.col("fecha_ingreso"))])()
        return rows, [*own, F.asc("_id")]

    def ordered_ids(self, cat: Catalogue, limit: int | None = None) -> DataFrame:
        """Only the ids, in order; uncapped unless a limit is given."""
        rows, keys = self.keys(cat, self.matching(cat))
        out = rows.orderBy(*keys).select("_id")
        return out.limit(limit) if limit is not None else out

    def total(self, cat: Catalogue) -> DataFrame:
        """One row ``n``: cards, a work's volumes being one, or documents."""
        rows = self.matching(cat)
        return rows.agg((F.count_distinct(F.coalesce("obra", "_id")) if self.agrupar else F.count("*")).alias("n"))

    def page(self, cat: Catalogue) -> DataFrame:
        """The documents of the page in order, with ``n_volumes`` when works are one card."""
        rows, keys = self.keys(cat, self.matching(cat))
        if self.agrupar:
            rows = one_card_per_work(rows, keys, F.coalesce("obra", "_id"))
        size = min(max(self.por_pagina, 1), 100)
        return rows.orderBy(*keys).offset((max(self.pagina, 1) - 1) * size).limit(size)


def members_in_order(docs: DataFrame, magazine: bool) -> list[Column]:
    """Order of a series' members: issues by their key, volumes by their number."""
    return [natural_key(F.col("clave_numero")), F.asc("_id")] if magazine else [number_key(F.col("coleccion_numero")), text_key(F.col("titulo")), F.asc("_id")]


def shelf(docs: DataFrame, ambito: str, estanteria: str, limit: int | None = None) -> DataFrame:
    """A shelf's documents by place, then ingest, then title."""
    rows = docs.where((F.col("ubicacion.ambito") == ambito) & (F.col("ubicacion.estanteria") == estanteria))
    rows = rows.orderBy(number_key(F.col("orden_estanteria")), F.asc("fecha_ingreso"), text_key(F.col("titulo")), "_id")
    return rows.limit(limit) if limit is not None else rows


def order_ids(ids: DataFrame, docs: DataFrame, by: str) -> DataFrame:
    """An id list by ingest (newest first) or by series and number; ids without a document are left out."""
    rows = docs.join(ids.select("_id"), "_id", "left_semi")
    keys = [F.desc("fecha_ingreso")] if by == "ingreso" else [text_key(F.col("coleccion_nombre")), number_key(F.col("coleccion_numero")), text_key(F.col("titulo"))]
    return rows.orderBy(*keys, "_id").select("_id")


def own_issn_as_name(series: DataFrame) -> DataFrame:
    """Series whose name is an ISSN, and whether it is their own."""
    name = F.trim("nombre")
    is_one = name.rlike(r"^\d{4}-?\d{3}[\dXx]$")
    return series.where(is_one | (F.col("nombre") == F.col("issn"))).select("_id", F.coalesce(issn(name) == F.col("issn"), name == F.col("issn"), F.lit(False)).alias("own"))


def identifiers_like(docs: DataFrame, text: str) -> DataFrame:
    """Documents with an identifier that begins with the digits of a text."""
    c = identifier_condition(text, [F.col("isbn"), F.col("issn"), F.col("isbn_obra")])
    return docs.where(c if c is not None else F.lit(False))
