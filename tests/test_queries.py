"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from shelfspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    place = [want.columns.index(c) for c in names]
    key = lambda r: tuple(x is not None and (1, x) or (0, "") for x in r)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=key)
    assert a == b


def test_entry_runs_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_tolerant_title_match_of_the_whole_table(spark):
    """Brute force over all parts, those beyond 400 included."""
    sf = "/root/testdata/sf0.01"
    by_brand = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        by_brand.setdefault(r.p_brand, []).append((r.p_partkey, {w for w in r.p_name.lower().split(" ") if len(w) >= 3}))
    want = set()
    for rows in by_brand.values():
        want |= {(a, b) for a, x in rows for b, y in rows if a < b and min(len(x), len(y)) and len(x & y) >= 0.6 * min(len(x), len(y))}
    got = [(r.a, r.b) for r in registry.queries()["tolerant_title_match"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(a > 400 for a, _ in want)


def test_every_row_has_a_place_in_its_folder(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    rows = registry.queries()["natural_order"](spark, SF).collect()
    folders = {}
    for r in rows:
        folders.setdefault(r.p_size, []).append(r.position)
    assert len(rows) == parts and all(sorted(p) == list(range(1, len(p) + 1)) for p in folders.values())
