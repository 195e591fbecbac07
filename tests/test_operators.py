"""Catalogue operators, sources and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from shelfspark.operators import catalog, clusters, merge, resolve, search, upkeep
from shelfspark.sources import fichero, files
from shelfspark.streaming import activity, inbox


def test_grammar(spark):
    terms, free = catalog.parse_fields("don quijote autor:cervantes -idioma:fr titulo:la mancha autor:miguel")
    assert free == "don quijote" and {(t.field, t.value, t.negative) for t in terms} == {("autor", "cervantes miguel", False), ("idioma", "fr", True), ("titulo", "la mancha", False)}
    assert catalog.parse_keywords("#guerra_civil #paz larga") == ["guerra civil", "paz larga"]
    assert catalog.rating_condition(F.lit(1), [0, 1, 2, 3, 4, 5]) is None and catalog.identifier_condition("1234", []) is None


def test_orders(spark):
    rows = spark.createDataFrame([("1", "Zeta", None, "o1"), ("2", "álamo", "10", "o1"), ("3", None, "9", None)], "_id string, titulo string, paginas string, obra string")
    rows = rows.selectExpr("*", "null as volumen_numero")
    ids = lambda *a: [r._id for r in rows.orderBy(*catalog.order_keys(*a)).collect()]
    assert ids("titulo") == ["2", "1", "3"] and ids("paginas") == ["3", "2", "1"] and ids("paginas", True) == ["2", "3", "1"]
    assert ids("azar", False, 5) == ids("azar", False, 5)


def test_merge_is_idempotent_and_keeps_values(spark):
    base = spark.createDataFrame([(1, "a", "x", True, False), (2, "", "x", False, False), (3, "c", "x", True, True)], "id int, t string, s string, pending boolean, locked boolean")
    new = spark.createDataFrame([(1, "z", "y"), (2, "b", "y"), (3, "z", "y"), (4, "d", "y")], "id int, t string, s string")
    once = merge.merge_records(base, new, "id", fill=["t"], upgrade=["s"])
    assert {r.id: (r.t, r.s) for r in once.collect()} == {1: ("a", "y"), 2: ("b", "x"), 3: ("c", "x"), 4: ("d", "y")}
    twice = merge.merge_records(once, new, "id", fill=["t"], upgrade=["s"])
    assert sorted(twice.collect()) == sorted(once.collect())


def test_dml(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("b", None)], "_id string, docs array<string>")
    assert [r.docs for r in merge.add_to_set(rows, "docs", ["x", "y"]).orderBy("_id").collect()] == [["x", "y"], ["x", "y"]]
    assert merge.pull(rows, "docs", ["x"]).where("_id = 'a'").first().docs == []
    flagged = merge.unique_or_flagged(spark.createDataFrame([("a", "k"), ("b", "k"), ("c", None)], "_id string, isbn string"), "isbn", ["_id"])
    assert {r._id: (r.isbn, r.revision_requerida) for r in flagged.collect()} == {"a": ("k", False), "b": (None, True), "c": (None, False)}
    remap = spark.createDataFrame([("x", "z")], "old string, new string")
    assert merge.remapped(rows.withColumn("docs", F.array(F.lit("x"), F.lit("z"))), "docs", remap).first().docs == ["z"]


def test_clusters(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 8), (3, 9), (6, 6)], "u long, v long")
    got = {r.node: r.root for r in clusters.connected(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 7, 8: 7}
    members = spark.createDataFrame([(1, "i1"), (1, "i2"), (4, "i3"), (4, None)], "root long, issn string")
    assert {r.root for r in clusters.vetoed(members, "root", "issn").collect()} == {4}
    assert clusters.connected(links.where("false")).count() == 0


def test_inventory(spark):
    volumes = spark.createDataFrame([("w", "doc-1", 1), ("w", "doc-3", 3), ("w", "doc-4", 3)], "obra string, _id string, numero int")
    works = spark.createDataFrame([("w", 3)], "obra string, total int")
    got = resolve.inventory(volumes, works)
    r = got.first()
    assert [tuple(v) for v in r.volumenes] == [(1, "doc-1"), (3, "doc-3")] and [tuple(h) for h in r.huecos] == [(2, 2)] and (r.presentes, r.completa, r.sin_numero, r.revision) == (2, False, ["doc-4"], True)
    assert sorted((x.numero, x._id) for x in resolve.listed(got).collect()) == [(1, "doc-1"), (2, None), (3, "doc-3")]


def test_resolution(spark):
    people = spark.createDataFrame([("p1", "José Pérez", ["Pepe"])], "_id string, nombre string, nombres_alternativos array<string>")
    got = {r.name: r.person for r in resolve.resolve_people(spark.createDataFrame([("jose perez",), ("PEPE",), ("Otro",), ("",)], "name string"), people).collect()}
    assert got["jose perez"] == got["PEPE"] == "p1" and got["Otro"].startswith("new:") and len(got) == 3
    series = spark.createDataFrame([("s1", "Cátedra, Letras Universales", None), ("s2", "X", "0317-8471")], "_id string, nombre string, issn string")
    rows = spark.createDataFrame([(1, "Letras Universales de Cátedra", None), (2, "zzz", "0317-8471"), (3, "zzz", None)], "id int, nombre string, issn string")
    assert {r.id: r.serie for r in resolve.resolve_series(rows, series).collect()} == {1: "s1", 2: "s2", 3: None}
    names = spark.createDataFrame([("a", "f", "pdf", "abcd"), ("b", "f", "pdf", "ab?d"), ("c", "f", "pdf", "wxyz"), ("d", "g", "pdf", "abcd")], "_id string, carpeta string, formato string, clave string")
    assert {r._id: r.grupo for r in resolve.cosmetic_groups(names).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    folder = spark.createDataFrame([("f", f"Obra vol {i}.pdf") for i in (1, 2, 3)] + [("g", "Uno.pdf"), ("g", "Tomo 1.pdf")], "carpeta string, nombre string")
    assert [tuple(r) for r in resolve.works_by_folder(folder).collect()] == [("f", 3, 3)]


def test_phrase_on_rows(spark):
    docs = spark.createDataFrame([(1, "El Quijote de la Mancha"), (2, "la mancha humana"), (3, None)], "id long, t string")
    assert {r.id for r in docs.where(search.phrase(F.col("t"), "La Mancha")).collect()} == {1, 2}
    assert docs.where(search.phrase(F.col("t"), " ")).count() == 0


def test_tasks(spark):
    docs = spark.createDataFrame([("a", None, {"t": 1}), ("b", "x", {}), ("c", None, None)], "_id string, cdu string, mantenimiento map<string,int>")
    task = upkeep.Task("t", 2, lambda: F.col("cdu").isNull(), lambda: {"cdu": F.lit("0")})
    once = upkeep.run_task(docs, task)
    assert {r._id: (r.cdu, r.mantenimiento["t"]) for r in once.collect()} == {"a": ("0", 2), "b": ("x", 2), "c": ("0", 2)}
    assert {r.state for r in upkeep.health(once, [task]).collect()} == {"hecha"}
    batch = upkeep.run_campaign(docs, task, 1, "mantenimiento")
    assert batch.where("cdu = '0'").count() == 1 and batch.count() == 3
    sides = upkeep.reconcile(spark.createDataFrame([("a",), ("b",)], "ruta string"), spark.createDataFrame([("b",), ("c",)], "ruta string"))
    assert {r.ruta: r.estado for r in sides.collect()} == {"a": "perdida", "b": "propia", "c": "huerfana"}


def test_authority_files(spark, tmp_path):
    edition = {"title": "T", "isbn_13": ["9780306406157"], "publish_date": "c2016.", "languages": [{"key": "/languages/eng"}], "authors": [{"key": "a2"}, {"key": "a1"}, {"key": "a9"}]}
    (tmp_path / "ol.tsv").write_text(f"/type/edition\tk\t1\td\t{json.dumps(edition)}\n/type/author\tk\t1\td\t{{}}\n")
    (tmp_path / "bne.json").write_text('[{"titulo":"U","isbn":"0306406152","fecha_publicacion":"2001","lengua_principal":"español","cdu":"82 /**/ x"},\n{"titulo":"V"}]\n')
    authors = spark.createDataFrame([("a1", "Ann"), ("a2", "Bob")], "author_key string, name string")
    r = fichero.map_ol(fichero.read_ol(spark, str(tmp_path / "ol.tsv")), authors).first()
    assert (r.isbn, r.titulo, r.anio_edicion, r.idioma, r.autores) == ("9780306406157", "T", 2016, "en", "Bob & Ann")
    got = fichero.map_bne(fichero.read_bne(spark, str(tmp_path / "bne.json"))).orderBy("titulo").collect()
    assert [(g.titulo, g.isbn, g.idioma, g.cdu) for g in got] == [("U", "9780306406157", "es", "82"), ("V", None, None, None)]


def test_archives(spark, tmp_path):
    def archive(name, entries):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b.getvalue())

    dc = 'xmlns:dc="http://purl.org/dc/elements/1.1/"'
    archive("a.epub", {"META-INF/container.xml": '<c><rootfile full-path="o.opf"/></c>', "o.opf": f"<p {dc}><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:identifier>urn:isbn:9780306406157</dc:identifier></p>"})
    archive("b.cbz", {"1.jpg": "", "2.png": "", "ComicInfo.xml": "<C><Series>S</Series><Writer>W, V</Writer></C>"})
    archive("c.docx", {"word/document.xml": "<d><p><t>uno</t><t> dos</t></p><p><t>tres</t></p></d>"})
    (tmp_path / "in" / "d.epub").write_bytes(b"broken")
    found = {r.ruta.rsplit("/", 1)[1]: r for r in files.contents(files.listing(spark, str(tmp_path / "in"))).collect()}
    assert (found["a.epub"].titulo, found["a.epub"].autores, found["a.epub"].isbn) == ("T", ["A"], "9780306406157")
    assert (found["b.cbz"].paginas, found["b.cbz"].titulo, found["b.cbz"].autores) == (2, "S", ["W", "V"])
    assert found["c.docx"].texto == "uno dos\ntres" and found["d.epub"].error == "BadZipFile"
    side = spark.createDataFrame([("x.pdf.meta.json", '{"titulo":"Forced","sin_isbn":"true"}')], "ruta string, json string")
    rows = spark.createDataFrame([("x.pdf", "Guns", "1"), ("y.pdf", "K", "2")], "ruta string, titulo string, isbn string")
    assert {r.ruta: (r.titulo, r.isbn) for r in files.overridden(rows, side, ["titulo", "isbn"]).collect()} == {"x.pdf": ("Forced", None), "y.pdf": ("K", "2")}


def test_throttle_in_batch(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate((0, 5, 9, 16, 18))], "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) as ts")
    assert {r.event_id for r in activity.throttled(rows, "user_id", 8000).collect()} == {0, 2, 4}
    assert [r.n for r in activity.debounced(rows, "user_id", "6 seconds").orderBy("start").collect()] == [3, 2]


def test_inbox(spark, tmp_path):
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.pdf").write_bytes(b"one")
    (tmp_path / "box" / "b.xyz").write_bytes(b"two")
    archived = spark.createDataFrame([(__import__("hashlib").sha256(b"one").hexdigest(),)], "hash string")
    stream = inbox.watched(spark, str(tmp_path / "box"))
    run = lambda batch, epoch: inbox.split_outcomes(inbox.routed(batch, archived), str(tmp_path / "out"), epoch)
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.outcome: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("outcome").count().collect()} == {"duplicado": 1, "cuarentena": 1}
