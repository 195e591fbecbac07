"""A text index on disk: postings by ranges of terms, document lengths, and replacement of changed documents.

Layout below one folder:

* ``postings/range=…``: ``term, id, field, tf, dl, positions``, sorted by term and id.  A range is an interval of (term, id), so a
  word that all documents have is spread over several ranges.
* ``docs/bucket=…``: ``id, dl, ranges``: how long a document is and which ranges hold its terms.
* ``stats/bucket=…``: documents and words of a bucket.
* ``bounds``: the first (term, id) of each range.

A search reads the ranges of its own terms only (partition pruning, then row groups by term).  A changed document touches the
ranges of its old and of its new terms, which dynamic partition overwrite replaces; the others stay as they are.  Writes go
postings, documents, statistics, and each is computed from what the one before it does not change, so a write that was cut off
is repeated as it was.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.model import fold, folded
from shelfspark.shipping import shipped

WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def words(query: str) -> list[str]:
    """The folded words of a query; none for an empty one."""
    return re.findall(r"[^\W_]+", fold(query or ""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, dl, field, w`` to one row a term; a document's words are all in its own row, so nothing is shuffled."""
    for batch in batches:
        lists = batch.column("w")
        flat = lists.flatten()
        if not len(flat):
            continue
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(batch.num_rows), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        coded = flat.dictionary_encode()
        key = of.astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        first, bounds = order[starts], np.append(starts, len(order)).astype(np.int32)
        rows = pa.array(of[first])
        positions = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[order].astype(np.int32)))
        out = [flat.take(pa.array(first)), batch.column("id").take(rows), batch.column("field").take(rows), pa.array(np.diff(bounds)), batch.column("dl").take(rows), positions]
        yield pa.RecordBatch.from_arrays(out, ["term", "id", "field", "tf", "dl", "positions"])


def postings_of(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``term, id, field, tf, dl, positions`` of each term of each field; ``dl`` counts the words of all fields."""
    shipped(docs.sparkSession)
    split = docs.select(F.col(id_col).alias("id"), *(tokens(F.col(c)).alias(c) for c in columns))
    dl = reduce(lambda a, b: a + b, (F.size(c) for c in columns))
    rows = split.select("id", dl.alias("dl"), F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("w")) for c in columns))).alias("x")).select("id", "dl", "x.field", "x.w")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_grouped, f"term string, id {kind}, field string, tf int, dl int, positions array<int>")


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder that all machines share."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    id_type: str
    buckets: int = 16

    # --- writing

    @staticmethod
    def build(docs: DataFrame, path: str, id_col: str, columns: list[str], *, ranges: int | None = None, buckets: int = 16) -> TextIndex:
        """Write the index of ``columns`` of ``docs``; rows without an id are left out, rows of one id must be one document."""
        spark = docs.sparkSession
        own = TextIndex(spark, path, tuple(columns), docs.schema[id_col].dataType.simpleString(), buckets)
        docs = docs.where(F.col(id_col).isNotNull())
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = postings_of(docs, id_col, columns).repartitionByRange(n, "term", "id").withColumn("range", F.spark_partition_id())
        rows.sortWithinPartitions("range", "term", "id", "field").write.partitionBy("range").parquet(f"{path}/postings")
        written = own._read("postings")
        written.groupBy("range").agg(F.min(F.struct("term", "id")).alias("b")).select("range", "b.term", "b.id").coalesce(1).write.parquet(f"{path}/bounds")
        own._write_docs(docs.select(F.col(id_col).alias("id")), written, "errorifexists")
        return own

    def _read(self, name: str) -> DataFrame:
        schema = {
            "postings": f"term string, id {self.id_type}, field string, tf int, dl int, positions array<int>, range int", "bounds": f"range int, term string, id {self.id_type}",
            "docs": f"id {self.id_type}, dl int, ranges array<int>, bucket int", "stats": "n long, words long, bucket int",
        }
        return self.spark.read.schema(schema[name]).parquet(f"{self.path}/{name}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _write_docs(self, ids: DataFrame, postings: DataFrame, mode: str) -> None:
        """``docs`` and ``stats``; a document without a word has no postings, but counts."""
        of = postings.where("id is not null").groupBy("id").agg(F.max("dl").alias("dl"), F.collect_set("range").alias("ranges"))
        rows = ids.join(of, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("ranges", F.array().cast("array<int>")).alias("ranges")).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").mode(mode).parquet(f"{self.path}/docs")
        self._write_stats(self._read("docs"), mode)

    def _write_stats(self, docs: DataFrame, mode: str) -> None:
        stats = docs.groupBy("bucket").agg(F.count("id").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("dl")).otherwise(0)).alias("words"))
        stats.write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode(mode).parquet(f"{self.path}/stats")

    @cached_property
    def bounds(self) -> list[tuple]:
        """``term, id, range`` in order; as many as there are ranges, and never changed after the index was built."""
        return [(r["term"], r["id"], r["range"]) for r in self._read("bounds").orderBy("range").collect()] or [("", None, 0)]

    def upsert(self, docs: DataFrame, id_col: str, gone: DataFrame | None = None) -> None:
        """Put ``docs`` in the place of what the index has of their ids, and take those of ``gone`` out in the same rewriting.

        An id in both is taken out.
        """
        rows = docs.where(F.col(id_col).isNotNull())
        out = None if gone is None else gone.select(F.col(id_col).alias("id")).where("id is not null").distinct()
        rows = rows if out is None else rows.join(out.withColumnRenamed("id", id_col), id_col, "left_anti")
        kept = rows.select(F.col(id_col).alias("id")).distinct()
        self._replace(kept if out is None else kept.unionByName(out), postings_of(rows, id_col, list(self.columns)), kept)

    def remove(self, ids: DataFrame, id_col: str) -> None:
        gone = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
        self._replace(gone, None, gone.where("false"))

    def _replace(self, ids: DataFrame, fresh: DataFrame | None, kept: DataFrame) -> None:
        ids = ids.withColumn("bucket", self._bucket())
        buckets = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most ``buckets``
        if not buckets:
            return
        docs = self._read("docs").where(F.col("bucket").isin(buckets))
        touched = {r["r"] for r in docs.join(ids, ["id", "bucket"], "left_semi").select(F.explode("ranges").alias("r")).distinct().collect()}  # at most as many as ranges
        new = None
        if fresh is not None:
            starts = self.bounds
            kind = fresh.schema["id"].dataType
            one = self.spark.createDataFrame([([(t, i) for t, i, _ in starts], [r for *_, r in starts])], T.StructType([T.StructField("b", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("id", kind)]))), T.StructField("r", T.ArrayType(T.IntegerType()))]))
            before = F.size(F.filter("b", lambda x: x <= F.struct(F.col("term"), F.col("id"))))
            new = fresh.crossJoin(F.broadcast(one)).withColumn("range", F.get("r", F.greatest(before, F.lit(1)) - 1)).drop("b", "r")  # one row
            touched |= {r["range"] for r in new.select("range").distinct().collect()}
        if touched:
            names = ["term", "id", "field", "tf", "dl", "positions", "range"]
            rows = self._read("postings").where(F.col("range").isin(list(touched))).join(ids, "id", "left_anti").where("id is not null").select(names)
            rows = rows.unionByName(new.select(names)) if new is not None else rows
            # a row without a term for each range, so that one which loses all its rows is overwritten too
            blank = self.spark.createDataFrame([(r,) for r in sorted(touched)], "range int").select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names[:-1]), "range")
            done = rows.unionByName(blank).repartition("range").sortWithinPartitions("range", "term", "id", "field")
            done.write.option("partitionOverwriteMode", "dynamic").partitionBy("range").mode("overwrite").parquet(f"{self.path}/postings")
        rest = docs.join(ids, ["id", "bucket"], "left_anti").where("id is not null").select("id", "dl", "ranges", "bucket")
        again = self._read("postings").where(F.col("range").isin(list(touched))).join(kept, "id", "left_semi").groupBy("id").agg(F.max("dl").alias("dl"), F.collect_set("range").alias("ranges"))
        added = kept.join(again, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("ranges", F.array().cast("array<int>")).alias("ranges")).withColumn("bucket", self._bucket())
        blank = self.spark.createDataFrame([(b,) for b in buckets], "bucket int").select(F.lit(None).cast(docs.schema["id"].dataType).alias("id"), F.lit(0).alias("dl"), F.array().cast("array<int>").alias("ranges"), "bucket")
        done = rest.unionByName(added).unionByName(blank).repartition("bucket")
        done.write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/docs")
        self._write_stats(self._read("docs").where(F.col("bucket").isin(buckets)), "overwrite")

    # --- reading

    def ranges_of(self, low: str, high: str | None = None) -> list[int]:
        """The ranges that may hold terms from ``low`` to below ``high`` (without it: ``low`` itself)."""
        starts = self.bounds
        terms = [t for t, *_ in starts]
        last = bisect_left(terms, high) if high is not None else bisect_left(terms, low + "\0")
        first = max(bisect_left(terms, low) - 1, 0)  # the range before may end with this term
        return [r for *_, r in starts[first : max(last, 1)]]

    def postings(self, own: list[str], prefix: bool) -> DataFrame:
        """The postings of words, or of all terms that they begin."""
        ranges = sorted({r for w in own for r in self.ranges_of(w, w + "\U0010ffff" if prefix else None)})
        match = any_of([F.col("term").startswith(w) if prefix else F.col("term") == w for w in own])
        return self._read("postings").where(F.col("range").isin(ranges) & match)

    def size(self) -> DataFrame:
        """One row: documents and words a document, from one row a bucket."""
        return self._read("stats").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.coalesce(F.try_divide(F.sum("words"), F.sum("n")), F.lit(0.0)).alias("_mean"))

    def _scored(self, hits: DataFrame, k: int) -> DataFrame:
        """``id, tf0.., dl`` to ``id, score, tf0..``: bm25 of ``k`` words, each counted by how often it stands in the document."""
        n_of = hits.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"_d{i}") for i in range(k)))

        def part(i: int) -> Column:
            tf, df = F.col(f"tf{i}"), F.col(f"_d{i}")
            idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
            return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("_mean"), F.lit(1e-9))))).otherwise(0.0)

        rows = hits.crossJoin(F.broadcast(n_of)).crossJoin(F.broadcast(self.size()))  # one row each
        return rows.select("id", reduce(lambda a, b: a + b, map(part, range(k))).alias("score"), *(f"tf{i}" for i in range(k)))

    def _none(self) -> DataFrame:
        return self._read("docs").where("false").select("id", F.lit(0.0).alias("score"))

    def search(self, query: str, *, exact: bool = False, every: bool = True) -> DataFrame:
        """``id, score`` of the documents that have every (or any) word of the query, as a beginning or exactly, in any field and order."""
        own = list(dict.fromkeys(words(query)))
        if not own:
            return self._none()
        counts = [F.sum(F.when(F.col("term") == w if exact else F.col("term").startswith(w), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, w in enumerate(own)]
        hits = self.postings(own, not exact).groupBy("id").agg(F.max("dl").alias("dl"), *counts)
        rows = self._scored(hits, len(own))
        found = [F.col(f"tf{i}") > 0 for i in range(len(own))]
        return rows.where(reduce(lambda a, b: a & b, found) if every else any_of(found)).select("id", "score")

    def phrase(self, query: str, field: str | None = None) -> DataFrame:
        """``id, score`` of the documents where the words stand side by side in one field."""
        own = words(query)
        if not own:
            return self._none()
        rows = self.postings(list(dict.fromkeys(own)), False)
        rows = rows.where(F.col("field") == field) if field else rows
        at = rows.groupBy("id", "field").agg(F.max("dl").alias("dl"), *(F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(own)))
        begun = lambda i: F.transform(F.col(f"p{i}"), lambda x: x - i)  # noqa: E731  where the phrase would begin
        shifted = [begun(i) for i in range(len(own))]
        at = at.withColumn("tf0", F.coalesce(F.size(reduce(F.array_intersect, shifted)), F.lit(0))).where("tf0 > 0")
        return self._scored(at.groupBy("id").agg(F.max("dl").alias("dl"), F.sum("tf0").alias("tf0")), 1).select("id", "score")

    def keywords(self, asked: list[str], field: str, limit: int = 1000) -> DataFrame:
        """``id, hits, best``: how many keywords a document has in ``field`` and its best place (from 0) in one keyword's first ``limit`` by bm25."""
        rows = None
        for k, keyword in enumerate(asked):
            if words(keyword):
                first = self.phrase(keyword, field).orderBy(F.desc("score"), "id").limit(limit)
                placed = first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).select("id", F.lit(k).alias("keyword"), "place")
                rows = placed if rows is None else rows.unionByName(placed)
        if rows is None:
            return self._none().select("id", F.lit(0).alias("hits"), F.lit(0).alias("best"))
        return rows.groupBy("id").agg(F.count_distinct("keyword").cast("int").alias("hits"), F.min("place").alias("best"))


def discover(index: TextIndex, authority: DataFrame, id_col: str, query: str, *, key: Column, limit: int = 40, over: int = 3) -> DataFrame:
    """Rows of the authority that a query finds, best first, one a ``key``; ``over`` times ``limit`` are looked at.

    Rows without a key are left out.
    """
    first = index.search(query).orderBy(F.desc("score"), "id").limit(limit * over)
    rows = authority.join(F.broadcast(first.select(F.col("id").alias(id_col), "score")), id_col).withColumn("_key", key).where(F.col("_key").isNotNull())
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("score"), id_col))).where("_r = 1")
    return best.drop("_r", "_key").orderBy(F.desc("score"), id_col).limit(limit)


def index_row(docs: DataFrame, authors: DataFrame, publishers: DataFrame, series: DataFrame) -> DataFrame:
    """``_id`` and the nine text columns of a document's index row.

    Original titles stand with the title, an ISSN with and without its hyphen, and names are joined in the order of their ids;
    ids without a name are left out.
    """
    name = lambda d, key, as_: d.select(F.col("_id").alias(key), F.col("nombre").alias(as_))
    flat = docs.select("_id", F.posexplode("autores").alias("at", "_author")).join(name(authors, "_author", "_n"), "_author").where("coalesce(_n, '') <> ''")
    of_author = flat.groupBy("_id").agg(F.concat_ws(" · ", F.transform(F.array_sort(F.collect_list(F.struct("at", "_n"))), lambda x: x["_n"])).alias("_authors"))
    rows = docs.join(of_author, "_id", "left").join(name(publishers, "editorial", "_publisher"), "editorial", "left").join(name(series, "coleccion", "_series"), "coleccion", "left")
    there = lambda c: F.when(F.col(c) != "", F.col(c))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "_id", F.concat_ws(" · ", there("titulo"), there("titulo_original"), F.filter(F.coalesce("titulos_originales", F.array().cast("array<string>")), lambda x: x != "")).alias("titulo"),
        text("subtitulo").alias("subtitulo"), text("obra_titulo").alias("obra"), text("_authors").alias("autores"), text("_publisher").alias("editorial"),
        F.coalesce(there("coleccion_nombre"), F.col("_series"), F.lit("")).alias("coleccion"), F.concat_ws(" ", "palabras_clave").alias("palabras_clave"),
        F.concat_ws(" ", there("isbn"), there("issn"), F.regexp_replace(there("issn"), "-", ""), there("isbn_obra")).alias("identificadores"), text("nombre_archivo").alias("nombre_archivo"),
    )
