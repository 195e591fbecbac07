"""Catalogue requests: texts with no field, one and several; filters; orders; ids only."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog, request
from shelfspark.operators.index import TextIndex, index_row
from shelfspark.operators.request import Catalogue, Request

DOCS = [
    # id, title, authors, publisher, series, work, volume, isbn, pages, day, rating, marked, keywords
    ("1", "Álgebra", ["a1"], "p1", "s1", "w1", "2", "9780306406157", "90", "2024-01-01", 0, None, ["Guerra civil"]),
    ("2", "algebra lineal", ["a2"], "p1", None, "w1", "11", None, None, "2024-01-02", 3, False, ["paz", "guerra civil"]),
    ("3", "Zoología", [], None, "s2", None, None, "0306406152", "x", "2024-01-02", None, True, []),
    ("4", None, None, "p2", None, None, None, "", "200", "2024-01-03", 5, None, None),
]
SCHEMA = "_id string, titulo string, autores array<string>, editorial string, coleccion string, obra string, volumen_numero string, isbn string, paginas string, dia string, valoracion int, nsfw boolean, palabras_clave array<string>"


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, SCHEMA).withColumn("fecha_ingreso", F.to_timestamp("dia")).drop("dia")
    none = ("subtitulo", "titulo_original", "obra_titulo", "coleccion_nombre", "coleccion_numero", "issn", "isbn_obra", "doi", "nombre_archivo", "orden_estanteria", "like")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in none}).withColumn("titulos_originales", F.lit(None).cast("array<string>"))
    docs = docs.withColumn("isbns_alternativos", F.lit(None).cast("array<struct<isbn:string>>")).withColumn("ubicacion", F.lit(None).cast("struct<ambito:string,estanteria:string>"))
    docs = docs.withColumn("contribuciones", F.when(F.col("_id") == "4", F.array(F.struct(F.lit("a1").alias("persona"))))).withColumn("doi", F.when(F.col("_id") == "4", "10.1234/abc"))
    people = lambda *rows: spark.createDataFrame(rows, "_id string, nombre string, nombres_alternativos array<string>")
    authors, publishers = people(("a1", "Verne, Jules", ["Жюль Верн"]), ("a2", "Ann", None)), people(("p1", "Cátedra", None), ("p2", "Gredos", ["Gredus"]))
    series = spark.createDataFrame([("s1", "Una", "1699-7913", False), ("s2", "1234-5679", "1234-5679", True)], "_id string, nombre string, issn string, nsfw boolean")
    works = spark.createDataFrame([("w1", False, True, False)], "_id string, completa boolean, revision_requerida boolean, nsfw boolean")
    selections = spark.createDataFrame([("mine", ["1", "4", "9"]), ("none", [])], "_id string, docs array<string>")
    rows = index_row(docs, authors, publishers, series)
    own = TextIndex.build(rows, str(tmp_path_factory.mktemp("request") / "i"), "_id", [c for c in rows.columns if c != "_id"], ranges=2, buckets=2)
    return Catalogue(docs, authors, publishers, works, series, selections, own)


def ids(cat, **k):
    return {r._id for r in Request(**k).matching(cat).collect()}


def test_texts(cat):
    bare = Catalogue(cat.docs, cat.authors, cat.publishers, cat.works, cat.series, cat.selections)
    assert ids(cat) == ids(cat, q="  ") == {"1", "2", "3", "4"}
    assert ids(cat, q="ALGEBRA") == {"1", "2"} and ids(bare, q="algebra") == {"2"}  # no index: accents count
    assert ids(cat, q="zzz") == set() == ids(bare, q="zzz")
    assert ids(cat, q="lineal alg", estricto=True) == set() and ids(cat, q="algebra lineal", estricto=True) == {"2"}
    assert ids(cat, q="жюль верн") == {"1"} and ids(cat, q="gredus") == {"4"} and ids(bare, q="ann") == {"2"}
    assert ids(cat, q="1699-7913") == {"1"} and ids(cat, q="978-0306") == set() and ids(cat, q="978-03064") == {"1"}
    assert ids(cat, q="https://doi.org/10.1234/ABC") == {"4"}
    assert ids(cat, q="#guerra_civil") == {"1", "2"} == ids(bare, q="#guerra_civil") and ids(cat, q="#") == set()


def test_fields(cat):
    assert ids(cat, q="title:álgebra") == {"1"} and ids(cat, q="autor:VERN") == {"1"} and ids(cat, q="-autor:vern") == {"2", "3", "4"}
    assert ids(cat, q="isbn:0306406152") == {"1", "3"} and ids(cat, q="-isbn:*") == {"2", "4"} and ids(cat, q="isbn:064061") == {"1", "3"}
    assert ids(cat, q="editorial:cátedra -titulo:lineal") == {"1"} and ids(cat, q="autor:*") == {"1", "2"} and ids(cat, q="autor:nobody") == set()
    assert ids(cat, q="alge publisher:cát") == {"1", "2"}
    assert catalog.parse_fields("hello world") == ([], "hello world") and catalog.parse_fields("") == ([], "")


def test_filters(cat, spark):
    assert ids(cat, dia="2024-01-02") == {"2", "3"} and ids(cat, estrellas=[0, 3]) == {"1", "2", "3"} and ids(cat, estrellas=list(range(6))) == {"1", "2", "3", "4"}
    assert ids(cat, nsfw="solo") == {"3"} and ids(cat, nsfw="excluir") == {"1", "2", "4"} and ids(cat, invitado=True) == {"1", "2", "4"}
    assert ids(cat, autor="a1") == {"1", "4"} and ids(cat, colecciones=["s1", "s2"]) == {"1", "3"} and ids(cat, seleccion="mine") == {"1", "4"} and ids(cat, seleccion="none") == set()
    assert ids(cat, filtro="obras_revision") == {"1", "2"} and ids(cat, filtro="sin_coleccion") == {"2", "4"}
    assert ids(cat, ids=spark.createDataFrame([("2",), ("7",)], "_id string")) == {"2"} and ids(cat, like="sin") == {"1", "2", "3", "4"}


def test_orders(cat):
    order = lambda **k: [r._id for r in Request(**k).ordered_ids(cat).collect()]
    assert order() == order(orden="fecha") == ["4", "2", "3", "1"] and order(orden="antiguo") == ["1", "2", "3", "4"]
    assert order(orden="titulo") == ["1", "2", "3", "4"] and order(orden="titulo", dir="desc") == ["4", "3", "2", "1"]
    assert order(orden="paginas") == ["1", "4", "2", "3"] and order(orden="paginas", dir="desc")[:2] == ["4", "1"]
    assert order(orden="autor")[:2] == ["2", "1"] and order(orden="obra")[0] == "1" and len(order(orden="coleccion")) == len(order(orden="posicion")) == 4
    assert order(orden="azar", seed="a") == order(orden="azar", seed="a") and {order(orden="azar", seed=str(i))[0] for i in range(9)} != {"1"}
    at = order(orden="azar", seed="b")
    assert abs(at.index("1") - at.index("2")) == 1  # volumes of a work stay together
    pages = [r._id for p in (1, 2) for r in Request(orden="azar", seed="b", agrupar=False, por_pagina=2, pagina=p).page(cat).collect()]
    assert pages == at
    assert order(q="álgebra lineal alg")[0] == "2"
    assert [(r._id, r.n_volumes) for r in Request().page(cat).collect()] == [("4", 1), ("2", 2), ("3", 1)] and Request().total(cat).first().n == 3
    assert [r._id for r in request.order_ids(cat.docs.where("_id <> '3'"), cat.docs, "ingreso").collect()] == ["4", "2", "1"]
    assert [(r._id, r.own) for r in request.own_issn_as_name(cat.series).collect()] == [("s2", True)]
