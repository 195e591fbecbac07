"""Images to documents by brute force; name patterns by example."""

import random

from shelfspark.operators import covers, patterns


def plain_same(a, b):
    differ = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return a == b or (len(a) == len(b) and all("?" in d for d in differ) and len(differ) <= max(1, len(a) // 4))


def test_matched_by_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("ab", k=rng.choice([1, 3, 8, 13, 24]))) for _ in range(40)]
    blur = lambda s: "".join("?" if rng.random() < 0.15 else c for c in s)
    docs = [(i, blur(rng.choice(base))) for i in range(120)] + [(900, ""), (901, None), (902, "same"), (903, "same")]
    images = [(i, blur(rng.choice(base))) for i in range(120)] + [(900, ""), (901, None), (902, "same"), (903, "sa?e")]
    names = [n for _, n in docs if n]
    frame = lambda rows: spark.createDataFrame(rows, "_id long, name string").repartition(3)
    got = {r.image: (r.state, r.doc, r.n) for r in covers.matched(frame(images), frame(docs)).collect()}
    fits = {i: [d for d, m in docs if m and n and plain_same(n, m)] for i, n in images}
    single = [f[0] for f in fits.values() if len(f) == 1]
    for i, own in fits.items():
        state = "sin_coincidencia" if not own else "ambiguo" if len(own) > 1 or single.count(own[0]) > 1 else "emparejado"
        assert got[i] == (state, own[0] if state == "emparejado" else None, len(own)), (i, own)
    assert len(names) > 100 and {s for s, *_ in got.values()} == {"sin_coincidencia", "ambiguo", "emparejado"}


def test_patterns(spark):
    names = ["L035-Eric_A._Posner.war_and_peace__a_story.Oxford_UP (1914) [Peterson].epub", "L036-Jan_K.other_tale.Oxford_UP (1915).epub", "L037-Ann_Bee.third_book.Yale_UP 1915.epub"]
    files = spark.createDataFrame([("f", n) for n in names] + [("one", "alone.pdf"), ("g", None), ("g", "x.pdf"), ("g", "")], "carpeta string, nombre string")
    found = patterns.detected(files)
    got = {r.carpeta: r for r in found.collect()}
    f = got["f"]
    assert (f.separator, f.pieces, f.blank, f.has_code, f.has_year, f.has_isbn, f.has_brackets) == (".", 3, True, True, True, False, False)
    assert f.fields == {0: "autor", 1: "titulo", 2: "editorial"} and "one" not in got and got["g"].separator is None
    rows = {r.nombre: r for r in patterns.applied(files, found).collect()}
    r = rows[names[0]]
    assert (r.titulo, r.subtitulo, r.autores, r.editorial, r.anio_edicion, r.coleccion_nombre, r.coleccion_numero) == ("war and peace", "a story", ["Eric A. Posner"], "Oxford UP", 1914, "L", 35)
    assert rows["alone.pdf"].titulo is None and len(rows) == 7
