"""Many values of a label."""

from pyspark.sql import functions as F

from shelfspark.llm import langid


def test_the_sample_takes_any_number_of_labels(spark):
    counts = {f"x{i}": i + 1 for i in range(2000)}
    rows = spark.range(2001).select("id", F.concat(F.lit("x"), "id").alias("lang")).withColumn("share", langid.share_of(counts, 400))
    assert {r.id: r.share for r in rows.collect()} == {i: 400 / (i + 1) for i in range(2000)} | {2000: 0.0}
