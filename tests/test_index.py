"""The text index on disk against plain searches of the texts, before and after documents change."""

import random
import re
import unicodedata
from glob import glob

import pytest
from pyspark.sql import functions as F

from shelfspark import model
from shelfspark.operators import index


def plain_words(text):
    text = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text)


VOCABULARY = ["Hello", "help", "HELL", "mañana", "Ά", "άνθρωπος", "йога", "Ω", "été", "the", "of", "don't", "x2", "42"]


def texts(seed, n=60):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randrange(12))), " ".join(rng.choices(VOCABULARY[:5], k=rng.randrange(4)))) for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "", " .,"), (n + 2, "the " * 3000, "the of")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "_id long, t string, k string")


def equal(own, rows):
    """All kinds of searches of an index find what a look at the texts finds."""
    split = {i: {"t": plain_words(t), "k": plain_words(k)} for i, t, k in rows}
    found = lambda df: {r.id for r in df.collect()}
    both = {i: w["t"] + w["k"] for i, w in split.items()}
    for query in ("Hel", "MANAN the", "иог α"):
        q = plain_words(query)
        assert found(own.search(query)) == {i for i, w in both.items() if all(any(x.startswith(p) for x in w) for p in q)}, query
        assert found(own.search(query, exact=True, every=False)) == {i for i, w in both.items() if set(q) & set(w)}, query
    for query in ("the of", "of the of", "été mañana"):
        q = plain_words(query)
        side = lambda w, q=q: any(w[i : i + len(q)] == q for i in range(len(w)))
        assert found(own.phrase(query)) == {i for i, w in split.items() if side(w["t"]) or side(w["k"])}, query
        assert found(own.phrase(query, "k")) == {i for i, w in split.items() if side(w["k"])}, query
    size = own.size().first()
    assert size["_n"] == len(rows) and size["_mean"] == pytest.approx(sum(map(len, both.values())) / len(rows))


def test_build_and_upkeep(spark, tmp_path):
    rows = texts(1)
    own = index.TextIndex.build(frame(spark, rows).repartition(3), str(tmp_path / "i"), "_id", ["t", "k"], ranges=9, buckets=4)
    equal(own, rows)
    changed = [(i, t, k) for i, t, k in texts(2)[:20]] + [(200, "new Ωmega the", "word"), (201, None, None)]
    own.upsert(frame(spark, changed), "_id")
    now = {r[0]: r for r in rows} | {r[0]: r for r in changed}
    equal(own, list(now.values()))
    own.upsert(frame(spark, changed), "_id")  # once more changes nothing
    own.remove(frame(spark, [(i, None, None) for i in (*range(10, 40), 62, 999)]), "_id")
    now = {i: r for i, r in now.items() if i not in {*range(10, 40), 62}}
    equal(own, list(now.values()))
    own.remove(frame(spark, list(now.values())), "_id")
    assert own.search("the").count() == 0 and own.size().first()["_n"] == 0
    own.upsert(frame(spark, rows), "_id")
    equal(own, rows)


def test_a_search_reads_only_its_ranges(spark, tmp_path):
    own = index.TextIndex.build(frame(spark, texts(3)), str(tmp_path / "i"), "_id", ["t", "k"], ranges=8, buckets=2)
    assert len(own.bounds) == 8 and len(own.ranges_of("zzz")) <= 2 and len(own.ranges_of("hel", "hel\U0010ffff")) < 8
    plan = own.search("zzz")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range", plan) and "StringStartsWith(term,zzz)" in plan
    before = {f: open(f, "rb").read() for f in glob(f"{tmp_path}/i/postings/*/*.parquet")}
    own.upsert(frame(spark, [(60, "йога", None)]), "_id")  # an empty document gets one word
    assert len({f for f in before if f not in set(glob(f"{tmp_path}/i/postings/*/*.parquet"))}) <= 3
    equal(own, [*texts(3)[:60], (60, "йога", None), *texts(3)[61:]])


def test_a_word_that_all_documents_have_is_spread(spark, tmp_path):
    own = index.TextIndex.build(frame(spark, [(i, "same", None) for i in range(900)]), str(tmp_path / "i"), "_id", ["t"], ranges=6)
    per = [r["count"] for r in spark.read.parquet(str(tmp_path / "i" / "postings")).groupBy("range").count().collect()]
    assert len(per) == 6 and max(per) < 400 and own.search("same").count() == 900
    own.upsert(frame(spark, [(5, "other", None), (2000, "same", None)]), "_id")
    assert own.search("same").count() == 900


def test_empty_queries_and_tables(spark, tmp_path):
    own = index.TextIndex.build(frame(spark, texts(4)), str(tmp_path / "i"), "_id", ["t", "k"], ranges=3)
    for query in ("", " ", ".,;", None):
        assert own.search(query).count() == own.phrase(query).count() == own.keywords([query or ""], "t").count() == 0
    none = index.TextIndex.build(frame(spark, []), str(tmp_path / "n"), "_id", ["t", "k"], ranges=3)
    assert none.search("the").count() == 0
    none.upsert(frame(spark, texts(5)), "_id")
    equal(none, texts(5))


def test_keywords(spark, tmp_path):
    rows = [(1, "guerra civil paz", None), (2, "paz", None), (3, "civil guerra", None), (4, "guerra civil " + "x " * 50, None)]
    own = index.TextIndex.build(frame(spark, rows), str(tmp_path / "i"), "_id", ["t"], ranges=2)
    got = own.keywords(["Guerra civil", "paz"], "t").orderBy(F.desc("hits"), "best", "id").collect()
    assert [(r.id, r.hits, r.best) for r in got] == [(1, 2, 0), (2, 1, 0), (4, 1, 1)]


def test_discover(spark, tmp_path):
    rows = [(1, "Same Title", "9780306406157"), (2, "same title", "9780306406157"), (3, "same title", None), (4, "SAME title", None), (5, "other", None)]
    base = spark.createDataFrame(rows, "_id long, t string, isbn string")
    own = index.TextIndex.build(base, str(tmp_path / "i"), "_id", ["t"], ranges=2)
    found = lambda **k: [r._id for r in index.discover(own, base, "_id", "tit sam", key=F.coalesce("isbn", F.lower("t")), **k).collect()]
    assert found() == [1, 3] and found(limit=1) == [1]


def test_index_row(spark):
    docs = spark.createDataFrame(
        [("d", "Guerra y paz", "War", ["", "Krieg"], ["a2", "a9", "a1"], "e", None, "s", ["x", "y"], "978", "1699-7913", ""), ("f", None, None, None, None, None, "Own", "s", None, None, None, None)],
        "_id string, titulo string, titulo_original string, titulos_originales array<string>, autores array<string>, editorial string, coleccion_nombre string, coleccion string, palabras_clave array<string>, isbn string, issn string, isbn_obra string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("subtitulo", "obra_titulo", "nombre_archivo")})
    named = lambda *rows: spark.createDataFrame(rows, "_id string, nombre string")
    got = {r._id: r for r in index.index_row(docs, named(("a1", "Ann"), ("a2", "Bob"), ("a9", "")), named(("e", "Ed")), named(("s", "Series"))).collect()}
    d, f = got["d"], got["f"]
    assert (d.titulo, d.autores, d.editorial, d.coleccion, d.palabras_clave, d.identificadores) == ("Guerra y paz · War · Krieg", "Bob · Ann", "Ed", "Series", "x y", "978 1699-7913 16997913")
    assert (f.titulo, f.autores, f.coleccion, f.identificadores) == ("", "", "Own", "")


def test_folding(spark):
    words = ["Ά", "йЙ", "ÑandÚ", "été", "Größe", "İ", "日本", "ǅ"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(model.folded(F.col("w")).alias("f")).collect()
    assert [r.f for r in got][:5] == ["α", "ии", "nandu", "ete", "große"] and [model.fold(w) for w in words[:5]] == [r.f for r in got][:5]
