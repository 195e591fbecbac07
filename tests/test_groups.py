"""Numbers and group surgery against plain loops: chains, cycles, gaps, hot groups, undo."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import groups, numbers


def plain_placed(rows):
    out = {}
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g and r[2] is not None and r[2] >= 1]
        editorial = {n for _, _, n, auto in own if not auto}
        taken, lost = set(editorial), []
        for i, _, n, auto in sorted(own):
            if auto and n in taken:
                lost.append((n, i))
            else:
                taken.add(n)
        for n, i in sorted(lost):
            free = n + 1
            while free in taken:
                free += 1
            taken.add(free)
            out[i] = (free, True)
    return {i: out.get(i, (n, False)) for i, _, n, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_placed(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.5 else f"g{rng.randrange(6)}", rng.choice([None, 0, rng.randrange(1, 9), rng.randrange(1, 60)]), rng.choice([True, True, False, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "_id long, serie string, n long, auto boolean").repartition(3)
    got = {r._id: (r.n, r.moved) for r in numbers.placed(df, "serie", "n", "auto").collect()}
    assert got == plain_placed([(i, g, n, bool(a)) for i, g, n, a in rows])


def test_free_numbers_and_gaps(spark):
    rows = [("g", 1), ("g", 2), ("g", 2), ("g", 4), ("g", 9), ("h", 2), ("i", None), ("j", 1), ("j", 2)]
    df = spark.createDataFrame(rows, "g string, n long")
    assert {r.g: r.free for r in numbers.next_free(df, "g", "n").collect()} == {"g": 3, "h": 1, "i": 1, "j": 3}
    totals = spark.createDataFrame([("g", 5), ("j", 4), ("k", 2)], "g string, total long")
    got = sorted(tuple(r) for r in numbers.gaps(df, "g", "n", totals).collect())
    assert got == [("g", 3, 3), ("g", 5, 8), ("h", 1, 1), ("j", 3, 4), ("k", 1, 2)]


def test_a_date_as_a_number_costs_nothing(spark):
    df = spark.createDataFrame([("g", 1), ("g", 30_000_000), ("g", 20_240_131)], "g string, n long")
    numbers.next_free(df, "g", "n").collect()
    start = time.time()
    assert numbers.next_free(df, "g", "n").first().free == 2
    assert sorted(tuple(r)[1:] for r in numbers.gaps(df, "g", "n").collect()) == [(2, 20_240_130), (20_240_132, 29_999_999)]
    assert time.time() - start < 10


def test_prefix_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), i, rng.randrange(9)) for i in range(300)]
    got = numbers.prefix(spark.createDataFrame(rows, "g string, i long, v long"), "g", ["i"], s=("sum", F.col("v")), m=("max", F.col("v"))).collect()
    for r in got:
        own = [v for g, i, v in rows if g == r.g and i <= r.i]
        assert (r.s, r.m) == (sum(own), max(own))


def test_union_by(spark):
    df = spark.createDataFrame([([(1, "a"), (2, "b"), (1, "c")], [(2, "z"), (3, "d"), (3, "e"), (None, "f")])], "x array<struct<k:int,v:string>>, y array<struct<k:int,v:string>>")
    (r,) = df.select(numbers.union_by(F.col("x"), F.col("y"), "k").alias("u")).collect()
    assert [tuple(x) for x in r.u] == [(1, "a"), (2, "b"), (3, "d")]
    (r,) = df.select(numbers.union_by(F.lit(None).cast("array<struct<k:int,v:string>>"), F.col("y"), "k").alias("u")).collect()
    assert [x.k for x in r.u] == [2, 3]


MERGES = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("m", "m"), ("n", "p"), ("n", "o"), (None, "q"), *((f"c{i:03}", f"c{i + 1:03}") for i in range(100))]


def merges(spark, rows=MERGES):
    return spark.createDataFrame(rows, "old string, new string")


def test_chains_and_cycles(spark):
    got = {r.old: (r.new, r.cycle) for r in groups.closed(merges(spark)).collect()}
    assert got["a"] == got["b"] == ("c", False) and got["n"] == ("o", False) and "m" not in got
    assert all(got[x] == (None, True) for x in "xyzw") and all(got[f"c{i:03}"] == ("c100", False) for i in range(100))
    assert groups.closed(merges(spark, [])).count() == 0


def test_merged_groups(spark):
    docs = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "x", "X"), (4, None, None), (5, "d", "D")], "_id long, coleccion string, coleccion_nombre string")
    own = spark.createDataFrame([(x, x.upper()) for x in "abcxyzd"], "_id string, nombre string")
    rows, left = groups.merge_groups(docs, own, "coleccion", merges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("d", "nowhere")]))
    assert {r._id: (r.coleccion, r.coleccion_nombre) for r in rows.collect()} == {1: ("c", "C"), 2: ("c", "C"), 3: ("x", "X"), 4: (None, None), 5: ("d", "D")}
    assert {r._id for r in left.collect()} == set("cxyzd")


def test_merged_people(spark):
    people = spark.createDataFrame([("a", "Ann", ["A."], 1900, None), ("b", "Anna", ["Ann", ""], None, "b.jpg"), ("c", "Anne", None, 1950, None), ("d", "Dan", None, None, None)], "_id string, nombre string, nombres_alternativos array<string>, nacimiento int, foto string")
    own = merges(spark, [("a", "b"), ("b", "c")])
    got = {r._id: r for r in groups.merge_people(people, own).collect()}
    assert set(got) == {"c", "d"} and (got["c"].nombres_alternativos, got["c"].nacimiento, got["c"].foto) == (["A.", "Ann", "Anna"], 1950, "b.jpg") and got["d"].nombres_alternativos is None
    docs = spark.createDataFrame([(1, ["d", "a", "c"], [("a", "trad"), ("b", "trad"), ("d", None)]), (2, None, None), (3, [], [])], "_id long, autores array<string>, contribuciones array<struct<persona:string,rol:string>>")
    rows = {r._id: r for r in groups.reassigned(docs, own).collect()}
    assert rows[1].autores == ["d", "c"] and [tuple(x) for x in rows[1].contribuciones] == [("c", "trad"), ("d", None)] and rows[2].autores is None


def test_explode_and_expel(spark):
    docs = spark.createDataFrame([(1, "w", "W", "1"), (2, "w", "W", "2"), (3, "v", "V", "1")], "_id long, obra string, obra_titulo string, volumen_numero string")
    own = spark.createDataFrame([("w",), ("v",), ("empty",)], "_id string")
    rows, left = groups.exploded(docs, own, "obra", own.where("_id = 'w'"))
    assert {r._id: (r.obra, r.obra_titulo, r.volumen_numero) for r in rows.collect()} == {1: (None,) * 3, 2: (None,) * 3, 3: ("v", "V", "1")} and {r._id for r in left.collect()} == {"v", "empty"}
    rows, left = groups.expelled(docs, own, "obra", docs.where("_id in (1, 3)").select("_id"))
    assert {r._id: r.obra for r in rows.collect()} == {1: None, 2: "w", 3: None} and {r._id for r in left.collect()} == {"w", "empty"}
    assert {r._id for r in groups.without_empty(own, docs, "obra", own).collect()} == {"w", "v"}


def test_undo(spark):
    before = spark.createDataFrame([(1, "a", [1], None), (2, "b", None, 2.5), (3, "c", [], 1.0)], "_id long, t string, l array<int>, d double")
    once = before.withColumns({"t": F.when(F.col("_id") < 3, F.lit(None)).otherwise(F.col("t")), "l": F.array(F.lit(9))})
    twice = once.withColumn("d", F.lit(7.0))
    at = lambda s: F.to_timestamp(F.lit(f"2026-01-01 10:00:0{s}"))
    log = groups.recorded(before, once, ["t", "l", "d"], at("1.2")).unionByName(groups.recorded(once, twice, ["t", "l", "d"], at("1.9")))
    back = groups.undone(twice, log, "2026-01-01 10:00:01", "2026-01-01 10:00:02", 3)
    assert sorted(map(str, back.collect())) == sorted(map(str, before.collect()))
    half = groups.undone(twice, log, "2026-01-01 10:00:01.5", "2026-01-01 10:00:02", 3)
    assert sorted(map(str, half.collect())) == sorted(map(str, once.collect()))
    with pytest.raises(ValueError, match="3 rows would change, 2 were expected"):
        groups.undone(twice, log, "2026-01-01 10:00:01", "2026-01-01 10:00:02", 2)


def test_dangling(spark):
    docs = spark.createDataFrame([(1, [("p", "trad", "Ann"), ("gone", "trad", "Bob"), ("lost", "il", "X")]), (2, [("gone", "trad", "Bob"), ("lost", "il", "Y"), (None, "il", "Z")]), (3, None)], "_id long, contribuciones array<struct<persona:string,rol:string,nombre:string>>")
    got = {(r.persona, r.rol): (r.nombre, r.docs) for r in groups.dangling(docs, spark.createDataFrame([("p",)], "_id string")).collect()}
    assert got == {("gone", "trad"): ("Bob", 2), ("lost", "il"): (None, 2)}
