"""Scalar functions on golden values."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark import model
from shelfspark.functions import classification as cl
from shelfspark.functions import identifiers as ident
from shelfspark.functions import marc, names, numerals, text
from shelfspark.sources import fichero


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in rows.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_isbn(spark):
    assert values(spark, ident.isbn, "978-84-19399-06-9", "0306406152", "030640615X", "abc", "", None) == ["9788419399069", "0306406152", None, None, None, None]
    assert values(spark, ident.isbn_to_13, "0306406152", "80-902734-1-6", "x") == ["9780306406157", "9788090273412", None]
    assert values(spark, ident.isbn_to_10, "9780306406157", "9791034904938") == ["0306406152", None]
    assert values(spark, ident.isbn_variants, "0306406152", "nothing") == [["0306406152", "9780306406157"], []]
    assert values(spark, ident.length_only_13, "978-84-19399-06-9", "", "abc", "0306406152") == ["9788419399069", None, None, "9780306406157"]


def test_issn_ean_doi(spark):
    assert values(spark, ident.issn, "0317-8471", "03178471", "0317-8472", "2434-561X", None) == ["0317-8471", "0317-8471", None, "2434-561X", None]
    assert values(spark, ident.issns_in, "ISSN 0317-8471, e-ISSN: 2434-561X issn 0317-8471", None) == [["0317-8471", "2434-561X"], []]
    assert [tuple(v) if v else None for v in values(spark, ident.ean, "9770317847001", "9780306406157", "4006381333931", "4006381333930")] == [("issn", "0317-8471"), ("isbn", "9780306406157"), ("commercial", "4006381333931"), None]
    assert values(spark, ident.doi_in, "see doi:10.1000/AB.12-3). And", "none") == ["10.1000/ab.12-3", None]
    assert values(spark, ident.isbns_in, "x 0-306-40615-2 y 978-0-306-40615-7.") == [["0306406152", "9780306406157"]]


def test_isbn_roles(spark):
    (got,) = values(spark, ident.isbns_with_role, "ISBN 84-03-04989-7 (obra completa) ISBN 0-306-40615-2 (tomo I) ISBN 978-0-306-40615-7 (pbk.)")
    assert [(r.isbn, r.role, r.number) for r in got] == [("8403049897", "obra", None), ("0306406152", "volumen", 1), ("9780306406157", "tapa_blanda", None)]


def test_isbn_bindings(spark):
    labels = {"cartonné": "tapa_dura", "soft cover": "tapa_blanda", "rústica": "tapa_blanda", "mobi": "ebook", "v. 2 : alk. paper": "volumen", "set": "obra", "alk. paper": "desconocido"}
    (got,) = values(spark, ident.isbns_with_role, " ".join(f"0-306-40615-2 ({x})" for x in labels))
    assert [r.role for r in got] == list(labels.values()) and got[4].number == 2


def test_fiction(spark):
    row = spark.range(1).select(cl.is_fiction(F.lit(None).cast("string"), F.lit(None).cast("string"), F.array(F.lit("Spanish POETRY"))).alias("a"), cl.is_fiction(F.lit(" 823"), F.lit("QA"), F.lit(None).cast("array<string>")).alias("b"), cl.is_fiction(F.lit("510"), F.lit("P1"), F.array(F.lit("x"))).alias("c")).first()
    assert list(row) == [True, True, False]


def test_volumes(spark):
    got = values(spark, names.volume, "Vol. 1 - United Nations.pdf", "Tomo I - Teatro.pdf", "Band 2 — Die Welt.pdf", "Endangered Species.2nd Ed.Vol1.pdf", "Obra_volumen_5.pdf", "Devolver el libro.pdf", "La evolución.pdf")
    assert [v and v.number for v in got] == [1, 1, 2, 1, 5, None, None]
    assert got[0].title == "United Nations" and got[3].prefix == "Endangered Species.2nd Ed"
    assert values(spark, names.declared_total, "Algo Vol 1-3", "Obra en 5 tomos", "Nada") == [3, 5, None]
    assert values(spark, numerals.to_arabic, "XII", "4", "IV", "x y", None) == [12, 4, 4, None, None]


def test_udc(spark):
    cases = {
        "821.161.1-31_18_": ("8", "821"), "004.738.55": ("0", "004"), "82.09 _ 821.14": ("8", "82"), "929 Velázquez, Diego": ("9", "929"), "913(410.111 L.)": ("9", "913"),
        "(460.23)": (cl.UNCLASSED, cl.UNCLASSED), "": (cl.UNCLASSED, cl.UNCLASSED), "9(569.4-18)": ("9", "9"), "1 Sócrates": ("1", "1"),
    }
    assert [(r["class"], r.division) for r in values(spark, cl.udc_tree, *cases)] == list(cases.values())
    assert values(spark, cl.dewey_to_udc, "005.133", "510/.3", "822.33", "920", "700", None) == ["004", "51", None, "929", "7", None]
    assert values(spark, cl.lcc_to_udc, "QA76", "TK5", "PQ1", None) == ["51", "6", None, None]


def test_titles(spark):
    bad = ["C:TARANTOLABOOK.DVI", "master.dvi", "Microsoft Word - recipes.doc", "Untitled", "Documento 1"]
    good = ["Web Design 2.0", "R.U.R.", "Python 3: The Complete Reference", "Documents in Contemporary Art"]
    assert values(spark, names.is_title_artefact, *bad, *good) == [True] * 5 + [False] * 4
    assert values(spark, names.is_author_artefact, "Acrobat Distiller 4.05", "García Márquez, Gabriel") == [True, False]
    bad = ["10.1007@978-3-319-38992-9", "New Page 12", "see http://x.org", "Subject: Ebooks", "Oxford.Descartes.And.The.Puzzle", "9780470040010-title", "0393333590 (N)", "Hawking FM", "TT-Ven.qxd 1", "jan09-1.pdf", "Creator: Adobe"]
    assert values(spark, names.is_title_artefact, *bad, "", None, "El Quijote") == [True] * len(bad) + [False] * 3
    bad = ["2013", "{avaxhome.ws}", "Sherman 1998 May 29 10:37:50", "www.x.com", "There are even a few exercises for you, but they", "Creator: x"]
    good = ["Anderson, Poul & Asimov, Isaac & Gardner, Martin & Clarke, Arthur", "University of Oxford", "", None]
    assert values(spark, names.is_author_artefact, *bad, *good) == [True] * len(bad) + [False] * 4
    assert values(spark, names.masthead, "Época núm. 12 extra", "Le Point août 2014", "Muy 2015", None) == ["Época", "Le Point", "Muy", None]
    real = "palabra clara " * 45
    assert values(spark, names.usable_text, real, "abc " * 200, "xyz! " * 50, None) == [True, False, False, False]
    assert [tuple(r) for r in values(spark, names.clean_title, "A :: B :: C", "A :", ":")] == [("A", "B : C"), ("A", None), (":", None)]
    assert values(spark, names.masthead, "Historia de Iberia Vieja nº145 – oct 2015", "Quo octubre 2015", "1984") == ["Historia de Iberia Vieja", "Quo", "1984"]


def test_series(spark):
    same = ["Cátedra, Letras Universales", "Letras Universales de Cátedra"]
    assert values(spark, names.canonical_key, *same, "Una") == ["catedra letras universales"] * 2 + [None]
    assert values(spark, names.clean_series, "Series on knots and everything ; v", "Arthurian studies, ISSN 0261-9814", ";") == ["Series on knots and everything", "Arthurian studies", ";"]
    assert [tuple(r) for r in values(spark, names.series_number, "Alianza Cien 15", "Alianza Cien nº 15", "Sin")] == [("Alianza Cien", "15"), ("Alianza Cien", "15"), ("Sin", None)]
    keys = spark.createDataFrame([(2015, "10", None), (None, None, "97"), (1977, None, None), (None, None, None), (2015, "octubre", "3")], "y int, m string, n string")
    assert [r.k for r in keys.select(names.issue_key(F.col("y"), F.col("m"), F.col("n")).alias("k")).collect()] == ["2015-10", "n97", "1977", None, "2015-10"]


def test_authors(spark):
    assert values(spark, names.split_authors, "A & B; C / D", "X y Z", "") == [["A", "B", "C", "D"], ["X y Z"], []]
    assert [tuple(r) for r in values(spark, names.author, "Ortega (1883-1955)/**/ ed.", "Uno, ( n. 1939 )")] == [("Ortega", 1883, 1955), ("Uno", 1939, None)]


def test_authority_values(spark):
    assert values(spark, fichero.year, "2015", "c2016.", "[2024]", None) == [2015, 2016, 2024, None]
    assert values(spark, fichero.pages, " 118 páginas", "210") == [118, 210]
    assert values(spark, fichero.language, "/languages/eng", "español", "Inglés", None) == ["en", "es", "en", None]


def test_resource_types(spark):
    cases = [({"dated": True, "own_isbn": False}, "revista"), ({"cip": True, "dated": True}, "libro"), ({"comic": True, "comic_number": True}, "revista"), ({"comic": True, "own_isbn": True, "comic_number": True}, "libro"), ({}, "libro"), ({"article_doi": True}, "articulo"), ({"issn_hint": True}, "revista")]
    row = spark.range(1).select(*(cl.resource_type({k: F.lit(v) for k, v in s.items()}).alias(f"c{i}") for i, (s, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]


def test_absence_and_order(spark):
    rows = spark.createDataFrame([("a10",), ("a9",), ("b",), (None,), ("",)], "x string")
    assert [r.x for r in rows.orderBy(model.natural_key(F.col("x")), F.col("x").isNull()).collect()] == ["", None, "a9", "a10", "b"]
    assert rows.where(model.absent(F.col("x"))).count() == 2
    assert values(spark, model.parse_int, "12a", " -3", "x", None) == [12, -3, None, None]
    assert values(spark, model.number_key, "7", "x", None) == [7.0, 1e9, 1e9]


def test_text(spark):
    assert text.fold("Ñandú ÉTÉ") == "nandu ete" and text.transliterate("Толстой") == "Tolstoy" and text.transliterate("Антон Чехов") == "Anton Chekhov" and text.transliterate("Βάσω") == "Vaso" and text.transliterate("Ann") == "Ann"
    assert text.same_work("abcd", "ab?d") and not text.same_work("abcd", "abce") and not text.same_work("ab", "??")
    assert text.clean_html('<p onclick="x">a<script>b</script><a href="javascript:1">c</a> &lt;</p>') == "<p>a<a>c</a> &lt;</p>"
    assert text.cosmetic("Mi Libro (2) [ocr].pdf") == "milibro"
    text.register(spark)
    assert spark.sql("select fold_accents('É') as v").first().v == "e"


def test_marc(spark):
    out = values(spark, lambda c: marc.record({"title": c, "year": F.lit("2001")}), "A & B", None)
    assert '<subfield code="a">A &amp; B</subfield>' in out[0] and "245" not in out[1] and "s2001" in out[0]


@given(st.text(alphabet="Ññáéí aB1", max_size=20))
def test_fold_is_idempotent(s):
    assert text.fold(text.fold(s)) == text.fold(s)


@pytest.mark.parametrize("path,want", [("a/b.EPUB", "epub"), ("x.cbz", "comic"), ("noext", "desconocido"), ("x.xyz", "otro"), ("a.M4B", "audio")])
def test_formats(spark, path, want):
    assert values(spark, cl.file_format, path) == [want]
