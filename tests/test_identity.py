"""Identity against a walk record by record; works, issues, numbers, marks; enrichment and spellings."""

import random

from pyspark.sql import functions as F

from shelfspark.functions.publishers import is_false_publisher, publisher_key
from shelfspark.operators import enrich, identity, spelling

SCHEMA = "_id long, tipo_recurso string, hash_contenido string, nombre_archivo string, obra string, volumen_numero string, coleccion string, clave_numero string, titulo string, anio_edicion int, mes_publicacion int, doi string, isbn string, formatos array<string>"


def walked(rows):
    """One record after the other, as they come in."""
    docs, out = [], {}
    for r in sorted(rows):
        i, kind, content, name, work, volume, series, issue, title, year, month, doi, isbn, formats = r
        same = next((d for d in docs if content and d["content"] == content), None)
        if same:
            out[i] = (same["id"], "actualizacion" if (same["own_name"] or None) == (name or None) else "duplicado_exacto")
            continue
        if work and volume:
            key = ("v", work, volume)
        elif kind == "revista":
            key = (("n", series, issue) if issue else None) if series else ("m", title, year, month) if title and year and month else ("y", title, year) if title and year else None
        elif kind == "articulo" and doi:
            key = ("d", doi)
        else:
            key = ("i", isbn, (formats or [""])[0] or "") if isbn and not work else None
        owner = next((d for d in docs if key and d["key"] == key and d["stays"]), None)
        if owner and not (owner["name"] and (name or key[0] == "i") and owner["name"] != name):
            out[i] = (owner["id"], "actualizacion")
            owner["name"] = owner["name"] or name or None
            docs.append({"id": owner["id"], "content": content, "own_name": name, "key": key, "name": name, "stays": False})
        else:
            out[i] = (i, "insercion")
            docs.append({"id": i, "content": content, "own_name": name, "key": key, "name": name or None, "stays": True})
    return out


def test_identity_by_walk(spark):
    rng = random.Random(7)
    pick = lambda *x: rng.choice(x)
    rows = [
        (i, pick("libro", "libro", "revista", "articulo", None), pick(None, "", f"h{rng.randrange(60)}"), pick(None, "", "a.pdf", "b.pdf"), pick(None, None, "w1", "w2"), pick(None, "1", "2"), pick(None, "s1", "s2"), pick(None, "", "n1", "n2"),
         pick(None, "t1", "t2"), pick(None, 1999, 2000), pick(None, 1, 2), pick(None, "10.1/x"), pick(None, "", "i1", "i2"), pick(None, [], ["pdf"], ["epub", "pdf"]))
        for i in range(300)
    ]
    got = {r._id: (r.target, r.operacion) for r in identity.identified(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = walked(rows)
    assert {i: x for i, x in got.items() if x != want[i]} == {i: want[i] for i in got if got[i] != want[i]} == {}
    assert all(got[t][0] == t for t, _ in got.values()) and {o for _, o in got.values()} == {"insercion", "actualizacion", "duplicado_exacto"}


def test_works_issues_and_numbers(spark):
    works = spark.createDataFrame([("w1", "Obra", None, "ed", None, None, 3), ("w2", "Otra", "978", None, None, "8", None)], "_id string, titulo string, isbn_obra string, editorial string, coleccion string, cdu string, total int")
    rows = spark.createDataFrame([(1, "Obra", "999", "x", None, "82", 2), (2, "zzz", "978", None, "c", "9", 5), (3, " ", None, None, None, None, None), (4, "Nueva", None, "e", None, None, 1), (5, "Nueva", None, None, "k", None, 4)], "_id long, titulo_obra string, isbn_obra string, editorial string, coleccion string, cdu string, total int")
    out, after = identity.resolved_works(rows, works)
    of, now = {r._id: r.obra for r in out.collect()}, {r._id: r for r in after.collect()}
    assert (of[1], of[2], of[3]) == ("w1", "w2", None) and of[4] == of[5] and of[4].startswith("new:")
    assert tuple(now["w1"])[1:] == ("Obra", "999", "ed", None, "82", 3) and tuple(now["w2"])[1:] == ("Otra", "978", None, "c", "8", 5) and tuple(now[of[4]])[1:] == ("Nueva", None, "e", "k", None, 4)
    docs = spark.createDataFrame([(1, "s", "2001-10"), (2, "s", "2001-2"), (3, "s", "2001-10"), (4, "s", None), (5, "t", ""), (6, None, "n1")], "_id long, coleccion string, clave_numero string")
    got = {r.coleccion: r for r in identity.issues(docs).collect()}
    assert [tuple(x) for x in got["s"].numeros] == [("2001-2", 2), ("2001-10", 3)] and (got["s"].sin_fecha, got["s"].revision) == ([4], True) and got["t"].presentes == 0 and set(got) == {"s", "t"}
    docs = spark.createDataFrame([(1, "s", "7b"), (2, "s", None), (3, "s", "x"), (4, None, None), (5, "t", None)], "_id long, coleccion string, coleccion_numero string")
    assert {r._id: r.coleccion_numero for r in identity.numbered_after(docs).collect()} == {1: "7b", 2: "8", 3: "9", 4: None, 5: "1"}


def test_volume_numbers_and_marks(spark):
    docs = spark.createDataFrame([(1, None, None, "0306406152", None), (2, "w", "1", "0306406152", None), (3, "w", "1", "9", None), (4, "w", "1", "9", None), (5, "w", "2", "9", None), (6, "w", "3", "9780306406157", "0306406152")], "_id long, obra string, volumen_numero string, isbn string, isbn_obra string")
    got = {r._id: (r.isbn, r.revision_requerida) for r in identity.safe_volume_isbns(docs).collect()}
    assert got == {1: ("0306406152", False), 2: (None, True), 3: ("9", False), 4: ("9", False), 5: (None, True), 6: (None, False)}
    docs = spark.createDataFrame([(1, "w", None, None), (2, None, "s", False), (3, "x", "x", None), (4, None, None, True)], "_id long, obra string, coleccion string, nsfw boolean")
    marks = lambda x: spark.createDataFrame([(x, True), ("x", False)], "_id string, nsfw boolean")
    assert {r._id: r.nsfw for r in identity.inherited_mark(docs, marks("w"), marks("s")).collect()} == {1: True, 2: True, 3: None, 4: True}


def test_ladder_and_enrichment(spark):
    said = spark.createDataFrame([(1, "google", "G", ["x"], "Pub", "0306406152"), (1, "cip", " ", [], None, None), (1, "fichero", "F", None, "Lulu Press", "9780306406157"), (1, "unknown", "U", ["u"], "U", "U"), (2, "bnf", "T", ["a"], None, "bad")], "_id long, fuente string, titulo string, autores array<string>, editorial string, isbn string")
    found = enrich.ladder(said, ["titulo", "autores", "editorial", "isbn"], only={"editorial": ("google",)})
    got = {r._id: r for r in found.collect()}
    assert (got[1].titulo, got[1].autores, got[1].editorial, got[1].isbn) == ("F", ["x"], "Pub", "9780306406157") and got[1].procedencia == {"titulo": "fichero", "autores": "google", "editorial": "google", "isbn": "fichero"}
    docs = spark.createDataFrame(
        [(1, "libro", "untitled", ["Acrobat Distiller 4.05"], "ePub Libre", "0306406152", None, True), (2, "libro", "Real", ["Ann"], None, None, None, False), (3, "revista", "Mag", None, "P", "bad", "0317-8471", False), (4, "libro", None, None, None, "123", None, False)],
        "_id long, tipo_recurso string, titulo string, autores array<string>, editorial string, isbn string, issn string, es_tomo boolean",
    ).withColumns({c: F.lit(None).cast("string") for c in ("cdu", "idioma", "coleccion_nombre")})
    rows = {r._id: r for r in enrich.enriched(docs, found, false_publisher=is_false_publisher(F.col("editorial"))).collect()}
    one = rows[1]
    assert (one.titulo, one.autores, one.editorial, one.isbn, one.estado_verificacion) == ("F", ["x"], "Pub", "0306406152", "completado") and len(one.alertas_agente) == 4
    assert (rows[2].titulo, rows[2].autores, rows[2].isbn, rows[2].estado_verificacion) == ("Real", ["Ann"], None, "pendiente") and rows[3].isbn == "bad" and rows[3].estado_verificacion == "completado"
    assert (rows[4].titulo, rows[4].isbn, rows[4].revision_requerida, rows[4].cdu, rows[4].idioma) == (None, None, True, "000", "es")
    changes = enrich.reclassified(docs, said, ("google",))
    assert [tuple(r) for r in enrich.transitions(changes).collect()] == [("ePub Libre", "Pub", 1, ["google"])]


def test_publishers(spark):
    df = spark.createDataFrame([("EPUB-Libre",), ("Lulu.com",), ("Luluvision",), ("Good Press",), ("Gredos",), (None,)], "p string")
    assert [r.x for r in df.select(is_false_publisher(F.col("p")).alias("x")).collect()] == [True, True, False, True, False, False]
    assert [r.x for r in spark.createDataFrame([("Editorial Gredos, S.A.",), ("GREDOS",), ("Press",)], "p string").select(publisher_key(F.col("p")).alias("x")).collect()] == ["a gredos s", "gredos", None]


def test_spellings_and_fused_names(spark):
    people = spark.createDataFrame([("1", "JOSÉ PÉREZ"), ("2", "Jose Perez"), ("3", "José Pérez"), ("4", "Ann Lee"), ("5", "Verne, Jules"), ("6", "Victor Hugo"), ("7", "Jules Verne Victor Hugo"), ("8", "Ann Lee & Bob Ray"), ("9", "Jules Verne Victor"), ("10", "Ann Lee Ann Lee Victor Hugo")], "_id string, nombre string")
    docs = spark.createDataFrame([(1, ["7", "4"], [("8", "trad"), ("4", None)]), (2, None, None), (3, ["2", "2"], [("2", "il")])], "_id long, autores array<string>, contribuciones array<struct<persona:string,rol:string>>")
    counts = spelling.references(docs)
    assert {r._id: r.n for r in counts.collect()} == {"7": 1, "4": 1, "8": 1, "2": 1}
    assert sorted(tuple(r) for r in spelling.spellings(people, counts).collect()) == [("1", "3"), ("2", "3")]
    got = {r.old: r.parts for r in spelling.fused(people).collect()}
    assert got["7"] == ["5", "6"] and got["10"] == ["4", "4", "6"] and got["8"][0] == "4" and got["8"][1].startswith("new:") and "9" not in got
    assert set(got) == {"7", "8", "10"}
    rows = {r._id: r for r in spelling.repointed(docs, spark.createDataFrame([("7", ["5", "4"]), ("8", ["4", "n"])], "old string, parts array<string>")).collect()}
    assert rows[1].autores == ["5", "4"] and [tuple(x) for x in rows[1].contribuciones] == [("4", "trad"), ("n", "trad"), ("4", None)] and rows[2].autores is None and rows[3].autores == ["2"]
