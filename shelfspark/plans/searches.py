"""Searches of a text index on disk.

An index is written once for each session and folder of tables, below the checkpoint folder, and read by every query after that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import index
from shelfspark.operators.clusters import shared_folder
from shelfspark.plans.registry import query, table

Row = DataFrame
_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"


def built(spark: SparkSession, d: str, name: str, id_col: str, columns: list[str]) -> index.TextIndex:
    known = spark.sparkContext.__dict__.setdefault("_shelfspark_indexes", {})
    if (d, name) not in known:
        known[d, name] = index.TextIndex.build(table(spark, d, name), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", id_col, columns)
    return known[d, name]


def documents(spark: SparkSession, d: str) -> index.TextIndex:
    return built(spark, d, "documents", "doc_id", ["text"])


_BM25 = "case when {t} > 0 then ln(1 + (nd - {d} + 0.5) / ({d} + 0.5)) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * dl / av)) else 0 end"


@query("bm25_top", f"""
with t as (select doc_id, {_TOKENS} as w from documents),
x as (select doc_id, len(w) as dl, len(list_filter(w, lambda y: y = 'license')) as t1, len(list_filter(w, lambda y: y = 'the')) as t2 from t),
n as (select count(*) as nd, sum(dl) / count(*) as av, count(*) filter (where t1 > 0) as d1, count(*) filter (where t2 > 0) as d2 from x)
select doc_id, round({_BM25.format(t="t1", d="d1")} + {_BM25.format(t="t2", d="d2")}, 6) as score
from x, n where t1 > 0 or t2 > 0 order by score desc, doc_id limit 50
""")
def bm25_top(spark: SparkSession, d: str) -> Row:
    """Any of the words, exactly; the query's words are folded."""
    ranked = documents(spark, d).search("License, The", exact=True, every=False)
    return ranked.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def _begins(prefix: str) -> str:
    return f"len(list_filter({_TOKENS}, lambda w: starts_with(w, '{prefix}'))) > 0"


@query("prefix_and_search", f"select doc_id from documents where {_begins('licen')} and {_begins('vers')}")
def prefix_and_search(spark: SparkSession, d: str) -> Row:
    return documents(spark, d).search("Licén VERS").select(F.col("id").alias("doc_id"))


@query("phrase_search", f"select doc_id from documents where contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' apache license ')")
def phrase_search(spark: SparkSession, d: str) -> Row:
    return documents(spark, d).phrase("Apache License").select(F.col("id").alias("doc_id"))


@query("keyword_ranking", f"""
with t as (select doc_id, {_TOKENS} as w from documents),
c as (select doc_id, len(w) as dl, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) as t1, len(list_filter(w, lambda y: y = 'license')) as t2 from t),
n as (select count(*) as nd, sum(dl) / count(*) as av, count(*) filter (where t1 > 0) as d1, count(*) filter (where t2 > 0) as d2 from c),
s as (select doc_id, t1, t2, {_BM25.format(t="t1", d="d1")} as s1, {_BM25.format(t="t2", d="d2")} as s2 from c, n),
k as (
  select doc_id, 1 as k, row_number() over (order by s1 desc, doc_id) - 1 as place from s where t1 > 0 union all
  select doc_id, 2, row_number() over (order by s2 desc, doc_id) - 1 from s where t2 > 0)
select doc_id, count(distinct k)::int as hits, min(place)::int as best from k where place < 1000 group by doc_id
""")
def keyword_ranking(spark: SparkSession, d: str) -> Row:
    """Most keywords first, then the best place in one keyword's list."""
    return documents(spark, d).keywords(["Of the", "LICENSE", " "], "text").select(F.col("id").alias("doc_id"), "hits", "best").orderBy(F.desc("hits"), "best", "doc_id")


@query("discovered_titles", """
with t as (select p_partkey, p_name, p_brand, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') as a, regexp_extract_all(lower(p_brand), '[\\p{L}\\p{N}]+') as b from part),
x as (select *, len(a) + len(b) as dl, len(list_filter(a || b, lambda w: starts_with(w, 'sma'))) as t1, len(list_filter(a || b, lambda w: starts_with(w, 'brand'))) as t2 from t),
n as (select count(*) as nd, sum(dl) / count(*) as av, count(*) filter (where t1 > 0) as d1, count(*) filter (where t2 > 0) as d2 from x),
s as (select p_partkey, p_name, p_brand, round(""" + _BM25.format(t="t1", d="d1") + " + " + _BM25.format(t="t2", d="d2") + """, 9) as score from x, n where t1 > 0 and t2 > 0),
f as (select * from s order by score desc, p_partkey limit 120)
select p_name, p_brand, p_partkey from f qualify row_number() over (partition by lower(p_name) || '|' || lower(p_brand) order by score desc, p_partkey) = 1 order by score desc, p_partkey limit 40
""")
def discovered_titles(spark: SparkSession, d: str) -> Row:
    """Titles and makers found by prefixes, one a title and maker."""
    found = index.discover(built(spark, d, "part", "p_partkey", ["p_name", "p_brand"]), table(spark, d, "part"), "p_partkey", "Brand SMA", key=F.concat_ws("|", F.lower("p_name"), F.lower("p_brand")))
    return found.select("p_name", "p_brand", "p_partkey")


@query("index_upkeep", f"""
with l as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id),
now as (select doc_id, case when quality = 0 then 'Zzrevised ' || upper(source) else text end as text from documents left join l using (doc_id) where toxic is distinct from 1),
t as (select doc_id, {_TOKENS} as w from now),
x as (select doc_id, len(w) as dl, len(list_filter(w, lambda y: y = 'the')) as t1, len(list_filter(w, lambda y: y = 'zzrevised')) as t2 from t),
n as (select count(*) as nd, sum(dl) / count(*) as av, count(*) filter (where t1 > 0) as d1, count(*) filter (where t2 > 0) as d2 from x)
select doc_id, round({_BM25.format(t="t1", d="d1")} + {_BM25.format(t="t2", d="d2")}, 6) as score from x, n where t1 > 0 or t2 > 0
""")
def index_upkeep(spark: SparkSession, d: str) -> Row:
    """An index after documents were taken out and others changed equals one of the documents as they are now."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    own = index.TextIndex.build(docs, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "doc_id", ["text"])
    own.upsert(docs.join(labels.where("quality = 0 and not toxic <=> 1"), "doc_id").select("doc_id", F.concat(F.lit("Zzrevised "), F.upper("source")).alias("text")), "doc_id", gone=labels.where("toxic = 1"))
    return own.search("the zzrevised", exact=True, every=False).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
