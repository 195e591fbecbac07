"""The resumable load: spans against whole files, stops in the middle of a file, repeated batches."""

import random

import pytest

from shelfspark.sources import lines


def test_spans_and_line_ends(tmp_path):
    rng = random.Random(6)
    text = "".join("é" * rng.randrange(0, 30) + rng.choice(["\n", "\r\n"]) for _ in range(200)) + "unfinished"
    (tmp_path / "a").write_bytes(text.encode())
    data, path = text.encode(), str(tmp_path / "a")
    assert lines.line_end(path, len(data), 0, block=7) == data.rfind(b"\n") + 1 and lines.line_end(path, 3, 3) == 3
    stop = data.rfind(b"\n") + 1
    cuts = sorted({0, stop, *(rng.randrange(stop) for _ in range(40))})
    got = [x for a, b in zip(cuts, cuts[1:]) for x in lines.read_span(lines.Span(path, a, b))]
    assert [x[2] for x in got] == text.replace("\r\n", "\n").split("\n")[:-1] and len({x[1] for x in got}) == len(got)


def test_stop_and_go_on(spark, tmp_path):
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.txt").write_text("".join(f"a{i}\n" for i in range(300)) + "half")
    (folder / "b.txt").write_text("x" * 5000 + "\n")
    failing = {"at": 2}

    def run(stop=True):
        def batch(df, n):
            lines.load_batch(df, n, root)
            if stop and n == failing["at"]:
                raise RuntimeError("stopped in the middle of a file, after its rows were written")

        q = lines.lines(spark, str(folder), 500, 120).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        return q

    q = run()
    with pytest.raises(Exception, match="stopped in the middle"):
        q.awaitTermination(60)
    q = run(stop=False)  # batch 2 comes again
    q.processAllAvailable()
    with open(folder / "a.txt", "a") as f:
        f.write(" more\nlast\n")
    q.processAllAvailable()
    q.stop()
    rows = [r.line for r in lines.loaded(spark, root, lines.SCHEMA).collect()]
    want = [f"a{i}" for i in range(300)] + ["half more", "last", "x" * 5000]
    assert sorted(rows) == sorted(want)


def test_a_batch_outside_the_ledger_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame([("p", 0, v) for v in x], lines.SCHEMA)
    lines.load_batch(rows("a", "b"), 0, root)
    lines.load_batch(rows("a", "b"), 0, root)
    rows("lost").write.parquet(f"{root}/rows/batch=1")
    lines.load_batch(rows(), 2, root)
    assert sorted(r.line for r in lines.loaded(spark, root, lines.SCHEMA).collect()) == ["a", "b"]
