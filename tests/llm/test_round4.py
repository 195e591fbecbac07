"""Findings of round 3 on the corpus operators."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from shelfspark.llm import simhash, skew


def final_plan(df):
    """The plan that ran, after what Spark saw of the sizes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_that_grows_is_broadcast(spark):
    nodes = spark.range(500).select(F.xxhash64("id").alias("node")).union(spark.range(500).select((F.xxhash64("id").bitwiseXOR(F.lit(1))).alias("node"))).repartition(3)
    found = simhash.links(nodes)
    plan = final_plan(found)
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and found.count() >= 500
    labels = simhash.labelled(nodes.withColumn("least_id", F.lit(1).cast("long")), nodes.withColumn("root", F.col("node")))
    assert "Broadcast" not in final_plan(labels)
    for share in (16, 1024):  # with a hot key and without
        rows = spark.range(2000).selectExpr("id", "if(id < 1000, -1, id) as k").repartition(3)
        assert "Broadcast" not in final_plan(skew.salted(rows, rows.select("k").distinct().withColumn("n", F.lit(1)), ["k"], share=share))


def test_near_dedup_goes_through_the_links_of_fingerprints(spark, monkeypatch):
    """The stage's fingerprints are linked through blocks, and those links are among what is compared."""
    words = lambda seed, n: [hashlib.md5(f"{seed} {i}".encode()).hexdigest()[:7] for i in range(n)]
    texts = [" ".join(words(i // 2, 900) + ["end"] * (i % 2)) for i in range(40)]
    prints = simhash.majority(simhash._mixed((s := simhash.shingle_sets(pa.array(texts)))[0], 1), s[1], len(texts))[:, 0].view("int64").tolist()
    close = {(u, v) for u in prints for v in prints if u < v and (u ^ v).bit_count() <= 4}
    seen, pairs = [], []

    def links(nodes, *args, own=simhash.links, **kw):
        seen.append({r.node for r in nodes.collect()})
        return own(nodes, *args, **kw)

    def alike(found, *args, own=simhash.alike):
        pairs.append(found.count())
        return own(found, *args)

    monkeypatch.setattr(simhash, "links", links)
    monkeypatch.setattr(simhash, "alike", alike)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(rows).collect()) == list(range(0, 40, 2))
    assert seen == [set(prints)] and pairs[0] >= 20 and close
    hubs = simhash._print_pairs(spark.createDataFrame([(b"%03d" % i, p) for i, p in enumerate(prints)], "node binary, fp long"))
    assert {(int(r.u), int(r.v)) for r in hubs.collect()} == {(i, i + 1) for i in range(0, 40, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 4}
