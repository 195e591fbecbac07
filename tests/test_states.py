"""Streams with state against the same walk over whole tables; the state ends."""

import random
import time

import pytest

from shelfspark.streaming import states


@pytest.fixture
def run(spark, tmp_path):
    """Feeds rows in several micro-batches and collects what a stream makes of them."""
    count = [0]

    def go(rows, schema, make, batches=3):
        count[0] += 1
        folder, name = tmp_path / f"in{count[0]}", f"states_{tmp_path.name}_{count[0]}".replace("-", "_")
        step = -(-len(rows) // batches)
        for i in range(batches):
            spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(folder))
        states.with_state_store(spark)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{count[0]}")).start()
        seen, until = {}, time.time() + 90
        while sum(seen.values()) < len(rows) and time.time() < until:  # a stream with times to live never runs out of batches
            assert q.exception() is None
            seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
            time.sleep(0.2)
        q.stop()
        left = sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:])
        return [tuple(r) for r in spark.sql(f"select * from {name}").collect()], left

    return go


def test_throttle(run):
    rng = random.Random(5)
    rows = sorted((rng.randrange(60_000), rng.randrange(4), i) for i in range(200))
    rows = [(k, t, i) for t, k, i in rows]
    want, last = set(), {}
    for k, t, i in rows:
        if k not in last or t - last[k] >= 8000:
            last[k] = t
            want.add((k, i))
    got, _ = run(rows, "user_id long, t_ms long, event_id long", lambda s: states.throttled(s, "user_id", 8000))
    assert set(got) == want and len(got) == len(want)


def test_files(run):
    looks = [("a", 0, 5), ("b", 0, 0), ("a", 1000, 9), ("a", 2600, 9), ("a", 3000, 9), ("c", 0, 1), ("b", 700_000, 0), ("a", 5000, 10), ("a", 7000, 10), ("c", 1000, 2)]
    got, _ = run(looks, "ruta string, t_ms long, bytes long", states.stable_files)
    assert sorted(got) == [("a", "estable"), ("a", "estable"), ("b", "fantasma")]


def test_folders(run):
    looks = [
        ("old", 100_000, 3, 30, 50_000), ("new", 100_000, 1, 10, 99_000), ("new", 120_000, 2, 20, 119_000), ("old", 120_000, 3, 30, 50_000), ("new", 150_000, 2, 20, 149_000), ("new", 165_000, 2, 20, 149_000),
        ("new", 170_000, 2, 20, 149_000), ("empty", 100_000, 0, 0, 0), ("gone", 100_000, 1, 1, 99_000), ("gone", 130_000, 0, 0, 0),
    ]
    got, left = run(looks, "carpeta string, t_ms long, ficheros long, bytes long, nuevo_ms long", states.stable_folders, 2)
    assert sorted(got) == [("new", 165_000), ("old", 100_000)]
    assert left == 2  # what is gone or empty has no state


def test_sticky(run):
    looks = [("a", 1, "normal"), ("a", 2, "audiolibro"), ("a", 3, "normal"), ("b", 1, "transmedia"), ("b", 2, "audiolibro"), ("b", 3, None), ("b", 4, "normal"), ("a", 4, "transmedia"), ("a", 5, None)]
    got, left = run(looks, "carpeta string, t_ms long, clase string", states.sticky_classes)
    assert sorted(got) == [("a", 1, "normal"), ("a", 2, "audiolibro"), ("a", 3, "audiolibro"), ("a", 4, "transmedia"), ("b", 1, "transmedia"), ("b", 2, "transmedia"), ("b", 4, "normal")]
    assert left == 1
