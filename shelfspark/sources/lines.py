"""A folder of growing line files as a resumable stream: positions are byte offsets, and a ledger makes each batch count once.

A position says for each file how many bytes are done; it always lies behind a line end, so a line that is still being written waits.
A load that stops anywhere, in the middle of a file too, goes on from its checkpoint.  The files must lie in a folder that all machines
see under one path.

Defined results: empty lines are rows; a last line without its end is not read before it has one; bytes that are no UTF-8 become
replacement characters; a file that got shorter is an error.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shelfspark.shipping import shipped

SCHEMA = "path string, start long, line string"


@dataclass
class Span(InputPartition):
    """The lines of a file that begin at ``start`` or later and before ``end``."""

    path: str
    start: int
    end: int


def line_end(path: str, limit: int, done: int, block: int = 1 << 16) -> int:
    """The byte behind the last line end up to ``limit``; ``done`` if there is none behind it."""
    with open(path, "rb") as f:
        at = limit
        while at > done:
            size = min(block, at - done)
            f.seek(at - size)
            cut = f.read(size).rfind(b"\n")
            if cut >= 0:
                return at - size + cut + 1
            at -= size
    return done


def read_span(span: Span, block: int = 1 << 20) -> Iterator[tuple[str, int, str]]:
    with open(span.path, "rb") as f:
        at = span.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the rest of a line that began before belongs to the span before
        f.seek(at)
        while at < span.end:
            line = f.readline()
            yield span.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.per_batch, self.per_task = options["path"], int(options.get("bytesperbatch", 64 << 20)), int(options.get("bytespertask", 8 << 20))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """At most ``bytesPerBatch`` further than the last offset, in order of file names."""
        at = dict(self.at or {})
        left = self.per_batch
        for path in sorted(e.path for e in os.scandir(self.root) if e.is_file() and not e.name.startswith((".", "_"))):
            done, size = at.get(path, 0), os.path.getsize(path)
            if size < done:
                raise ValueError(f"{path} has become shorter")
            limit, end = min(size, done + left), done
            while limit > done and (end := line_end(path, limit, done)) == done and limit < size:
                limit = min(size, limit + self.per_batch)  # one line longer than a batch is a batch of its own
            if end > done:
                at[path], left = end, left - (end - done)
            if left <= 0:
                break
        self.at = at
        return {"files": json.dumps(at, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.at = after if self.at is None else self.at
        spans = []
        for path, stop in sorted(after.items()):
            a = before.get(path, 0)
            while a < stop:
                b = min(stop, a + self.per_task)
                spans.append(Span(path, a, b))
                a = b
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition)

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    """``spark.readStream.format("shelf_lines").option("bytesPerBatch", …).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "shelf_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineReader:
        return LineReader({k.lower(): v for k, v in self.options.items()})


def lines(spark: SparkSession, folder: str, bytes_per_batch: int = 64 << 20, bytes_per_task: int = 8 << 20) -> DataFrame:
    """``path, start, line`` of the folder's files as a stream."""
    shipped(spark)
    spark.dataSource.register(LineSource)
    return spark.readStream.format("shelf_lines").option("bytesPerBatch", bytes_per_batch).option("bytesPerTask", bytes_per_task).load(folder)


# --- loading, each batch once


def load_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """For ``foreachBatch``: the rows below ``rows/batch=…``, then the batch's line in the ledger; a repeated batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
    spark = batch.sparkSession
    written = spark.read.parquet(f"{root}/rows/batch={batch_id}")
    done = written.agg(F.lit(batch_id).cast("long").alias("batch"), F.count("*").alias("n"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/batch_id={batch_id}")


def loaded(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all batches in the ledger; what a batch left that never got there is not seen."""
    ledger = spark.read.schema("batch long, n long").parquet(f"{root}/ledger")
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return rows.join(F.broadcast(ledger.select("batch")), "batch", "left_semi").drop("batch")  # one row a batch
