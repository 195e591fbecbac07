"""Listing of sketches from two subtables, and its way back to all three."""

import hashlib
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import iblt


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def check_of(high):
    return xxhash.xxh64_intdigest(high.to_bytes(8, "little"), 42) & iblt.CHECK


def digest(name):
    high = int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little") & ~iblt.CHECK
    return high | check_of(high)


def listed(spark, keys, m):
    """The digests that two subtables of ``m`` cells tell, or None."""
    rows = spark.createDataFrame([([signed(k) for k in keys], m)], "keys array<long>, m long").withColumn("_mask", F.col("m") - 1)
    rows = iblt.with_cells(rows, "u", iblt._all_places(F.col("keys")), "keys").drop("_mask")
    return iblt.with_peeled(rows, "found", "u", "m").first().found


def test_full_peeling_is_for_few_rows(spark, monkeypatch):
    """Texts as they come are compared without the three subtables' peeling, also if their sketches differ in size."""
    monkeypatch.setattr(iblt, "peeled", lambda cells, size, rounds=60: F.struct(F.raise_error(F.lit("peeled")).cast("boolean").alias("ok"), F.array().cast("array<bigint>").alias("found")))
    texts = ["\n".join(f"line {j} of {i % 3}" for j in range(i * 5 % 31)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(filter(None, t.split("\n"))) for t in texts]
    for r in iblt.compare_next(docs).collect():
        a, b = sets[r.doc_id], sets[(r.doc_id + 1) % len(sets)]
        assert r.near_next == (len(a & b) / len(a | b) if a | b else 1.0)


def test_two_subtables_list_all_or_say_so(spark):
    """Whatever the load, the list is whole or null; with room it is whole."""
    for n, m, sure in ((0, 64, True), (1, 64, True), (40, 1024, True), (300, 256, False), (50, 16, False), (5, 1, False)):
        keys = [digest(f"{n} {i}") for i in range(n)]
        found = listed(spark, keys, m)
        assert (found is None and not sure) or sorted(found) == sorted(map(signed, keys)), (n, m)


def test_three_digests_that_look_like_one(spark):
    """A cell of three digests whose XOR fits the check is not taken for one digest."""
    m = 64
    same = [d for d in (digest(str(i)) for i in range(9000)) if d & (m - 1) == 5][:120]
    looks = lambda t: check_of((t[0] ^ t[1] ^ t[2]) & ~iblt.CHECK) == (t[0] ^ t[1] ^ t[2]) & iblt.CHECK
    apart = lambda t: len({d >> 16 & (m - 1) for d in t}) == 3
    three = next(t for t in combinations(same, 3) if looks(t) and apart(t))
    found = listed(spark, three, m)
    assert found is None or sorted(found) == sorted(map(signed, three))
    rows = spark.createDataFrame([([signed(k) for k in three],)], "keys array<long>")
    assert iblt.with_fingerprint(rows, "f", "keys", first=m, room=0).first().f.n == 3


def test_tables_with_very_long_texts_take_few_projections(spark, monkeypatch):
    """Both ways give the same rows; a longest text beyond the bound decides."""
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of {i % 3}" for j in range(i * 9 % 40))) for i in range(8)], "doc_id long, text string")
    assert "_xk" in iblt.compare_next(docs)._jdf.queryExecution().analyzed().toString()
    fast = sorted(map(tuple, iblt.compare_next(docs).collect()))
    monkeypatch.setattr(iblt, "WIDE", 100)
    few = iblt.compare_next(docs)
    assert "_xk" not in few._jdf.queryExecution().analyzed().toString() and sorted(map(tuple, few.collect())) == fast
