"""Queries on records with arrays, nested fields and identifiers, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark import model
from shelfspark.functions import classification as cl
from shelfspark.functions import identifiers as ident
from shelfspark.functions import marc, names
from shelfspark.operators import catalog, merge, resolve, search, upkeep
from shelfspark.plans.registry import query, table
from shelfspark.streaming import activity

Row = DataFrame


def _orders_with_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents: ``_id, autores`` (suppliers in line order), ``formatos`` (return flags)."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("x"), F.sort_array(F.collect_set("l_returnflag")).alias("formatos"))
    return g.select("_id", F.array_distinct(F.col("x.l_suppkey")).alias("autores"), "formatos")


@query("filter_format_contains", "select l_orderkey as _id from lineitem group by 1 having bool_or(l_returnflag = 'A') and not bool_or(l_returnflag = 'R')")
def filter_format_contains(spark: SparkSession, d: str) -> Row:
    rows = _orders_with_arrays(spark, d)
    return rows.where(catalog.has_format("A") & ~catalog.has_format("R")).select("_id")


@query("filter_code_prefix", "select p_partkey from part where starts_with(p_brand, 'Brand#1') and p_brand <> 'Brand#11'")
def filter_code_prefix(spark: SparkSession, d: str) -> Row:
    return table(spark, d, "part").where(F.col("p_brand").startswith("Brand#1") & (F.col("p_brand") != "Brand#11")).select("p_partkey")


@query("filter_author_or_contributor", "select distinct l_orderkey as _id from lineitem where l_suppkey = 7 or l_partkey = 7")
def filter_author_or_contributor(spark: SparkSession, d: str) -> Row:
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.collect_set("l_suppkey").alias("a"), F.collect_list(F.struct(F.col("l_partkey").alias("persona"))).alias("c"))
    return g.where(F.array_contains("a", 7) | F.exists("c", lambda x: x["persona"] == 7)).select("_id")


@query("filter_by_selection", "select o_orderkey, o_orderstatus from orders where o_orderkey in (select min(l_orderkey) from lineitem group by l_suppkey)")
def filter_by_selection(spark: SparkSession, d: str) -> Row:
    chosen = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("m"))
    return table(spark, d, "orders").join(chosen.select(F.col("m").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("filter_nested_presence", "select event_id from events where cast(json_extract_string(props, '$.k') as integer) >= 50")
def filter_nested_presence(spark: SparkSession, d: str) -> Row:
    return table(spark, d, "events").select("event_id", F.from_json("props", "struct<k:string>").alias("p")).where("p.k is not null and try_cast(p.k as int) >= 50").select("event_id")


@query("quality_filters", "select count(*) filter (where l.quality is null) as pending, count(*) filter (where (d.lang is null or d.lang = '') and d.doc_id % 2 = 0) as no_isbn, count(*) filter (where n_chars > 5000 and l.toxic is null) as review, count(*) filter (where l.toxic is null and l.quality is not null) as no_number from documents d left join labels l on d.doc_id = l.doc_id")
def quality_filters(spark: SparkSession, d: str) -> Row:
    """The named filters on documents, the even ones of which are books."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.when(F.col("doc_id") % 2 == 0, "libro").otherwise("revista").alias("tipo_recurso"), F.col("lang").alias("isbn"), F.when(F.col("quality").isNull(), "pendiente").alias("estado_verificacion"),
        ((F.col("n_chars") > 5000) & F.col("toxic").isNull()).alias("revision_requerida"), F.col("quality").alias("obra"), F.col("toxic").alias("volumen_numero"))
    named = {"pending": "pendientes", "no_isbn": "sin_isbn", "review": "revision", "no_number": "tomos_sin_numero"}
    return rows.agg(*[F.count_if(catalog.QUALITY[q]()).alias(n) for n, q in named.items()])


@query("unsealed_candidates", "select c_custkey from customer where case c_custkey % 3 when 0 then null else c_custkey % 3 end is distinct from 2")
def unsealed_candidates(spark: SparkSession, d: str) -> Row:
    task = upkeep.Task("t", 2, lambda: F.lit(True), dict)
    v = F.col("c_custkey") % 3
    seals = F.when(v == 0, F.create_map().cast("map<string,int>")).otherwise(F.create_map(F.lit("t"), v.cast("int")))
    return table(spark, d, "customer").select("c_custkey", seals.alias("mantenimiento")).where(upkeep.unsealed(task)).select("c_custkey")


@query("card_projection", "select l_orderkey as _id, greatest(count(*) filter (where l_returnflag = 'R'), case when bool_or(l_linenumber = 1) then 1 else 0 end) as n_images from lineitem group by 1")
def card_projection(spark: SparkSession, d: str) -> Row:
    """The number of images: as many as there are, or one if there is only a cover."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("images"), F.max((F.col("l_linenumber") == 1).cast("int")).alias("cover"))
    return g.select("_id", F.when(F.size("images") > 0, F.size("images")).otherwise(F.col("cover")).cast("long").alias("n_images"))


@query("page_badges", "select o_custkey, count(*) as n from orders where o_custkey in (select c_custkey from customer order by c_acctbal desc, c_custkey limit 24) group by 1")
def page_badges(spark: SparkSession, d: str) -> Row:
    shown = catalog.page(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), [F.desc("c_acctbal"), F.asc("o_custkey")])
    return table(spark, d, "orders").join(F.broadcast(shown), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))  # a page has at most 100 rows


@query("distinct_of_arrays", "select distinct l_suppkey as person from lineitem")
def distinct_of_arrays(spark: SparkSession, d: str) -> Row:
    return _orders_with_arrays(spark, d).select(F.explode("autores").alias("person")).distinct()


@query("patterns_by_source", "select source, count(*) as n, count(*) filter (where text like '%License%') as licensed, count(*) filter (where lang = 'en') as english from documents group by 1")
def patterns_by_source(spark: SparkSession, d: str) -> Row:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").like("%License%")).alias("licensed"), F.count_if(F.col("lang") == "en").alias("english"))


@query("works_to_review_first", "select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderstatus = 'P' desc, o_orderstatus = 'O' desc, o_orderkey limit 500")
def works_to_review_first(spark: SparkSession, d: str) -> Row:
    return table(spark, d, "orders").orderBy((F.col("o_orderstatus") == "P").desc(), (F.col("o_orderstatus") == "O").desc(), "o_orderkey").limit(500).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("relevance_order", "select doc_id, rank from (select doc_id, row_number() over (order by coalesce(r, 1000000000), n_chars desc, doc_id) as rank from (select doc_id, n_chars, case when contains(text, 'License') then n_chars end as r from documents)) where rank <= 100")
def relevance_order(spark: SparkSession, d: str) -> Row:
    rank = F.coalesce(F.when(F.contains("text", F.lit("License")), F.col("n_chars")), F.lit(1_000_000_000))
    top = table(spark, d, "documents").select("doc_id", "n_chars", rank.alias("r")).orderBy("r", F.desc("n_chars"), "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy("r", F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))


@query("seeded_shuffle")
def seeded_shuffle(spark: SparkSession, d: str) -> Row:
    """A random order that a seed fixes, with the volumes of a work together; values of the hash are Spark's own."""
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("_id"), F.col("l_orderkey").cast("string").alias("obra"), F.col("l_linenumber").cast("string").alias("volumen_numero"))
    return catalog.page(rows, catalog.order_keys("azar", seed=7), size=100)


@query("array_unions", "select o_custkey, string_agg(distinct x, ',' order by x) as statuses from (select o_custkey, o_orderstatus as x from orders union all select o_custkey, o_orderpriority from orders) group by 1")
def array_unions(spark: SparkSession, d: str) -> Row:
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set("o_orderpriority").alias("b"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("statuses"))


@query("identifiers_in_pages")
def identifiers_in_pages(spark: SparkSession, d: str) -> Row:
    """ISBNs, ISSNs and the first DOI of every page, and whether its text is usable."""
    return table(spark, d, "pages").select("page_id", ident.isbns_in(F.col("html")).alias("isbns"), ident.issns_in(F.col("html")).alias("issns"), ident.doi_in(F.col("html")).alias("doi"), names.usable_text(F.col("html")).alias("usable"))


@query("issn_checks", """
with k as (select p_partkey, lpad(cast(p_partkey as varchar), 7, '0') as b from part),
c as (select *, (11 - (""" + " + ".join(f"cast(substr(b, {i}, 1) as int) * {9 - i}" for i in range(1, 8)) + """) % 11) % 11 as r from k)
select p_partkey, case when p_partkey % 10 = r then substr(b, 1, 4) || '-' || substr(b, 5, 3) || cast(r as varchar) end as issn from c
""")
def issn_checks(spark: SparkSession, d: str) -> Row:
    c = F.concat(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", ident.issn(c).alias("issn"))


@query("usable_texts", "select doc_id, length(regexp_replace(text, '\\s', '', 'g')) >= 200 and len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) >= 0.6 * length(regexp_replace(text, '\\s', '', 'g')) and len(list_filter(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ]{4,}'), lambda w: regexp_matches(w, '[aeiouáéíóúàèìòùäëïöüy]'))) >= 40 as usable from documents")
def usable_texts(spark: SparkSession, d: str) -> Row:
    return table(spark, d, "documents").select("doc_id", names.usable_text(F.col("text")).alias("usable"))


@query("code_trees", "select p_partkey, substr(cast(p_partkey as varchar), 1, 1) as class, substr(cast(p_partkey as varchar), 1, 3) as division from part")
def code_trees(spark: SparkSession, d: str) -> Row:
    t = cl.udc_tree(F.concat(F.col("p_partkey").cast("string"), F.lit(" literal")))
    return table(spark, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", F.col("t.class").alias("class"), F.col("t.division").alias("division"))


@query("crosswalk", "select p_partkey, case when p_partkey % 10 = 0 then '004' when p_partkey % 100 >= 10 then substr(cast(500 + p_partkey % 300 as varchar), 1, 2) else substr(cast(500 + p_partkey % 300 as varchar), 1, 1) end as udc from part")
def crosswalk(spark: SparkSession, d: str) -> Row:
    """Codes of computing, and of the classes 5 to 7 by tens."""
    dewey = F.when(F.col("p_partkey") % 10 == 0, F.lit("005.133")).otherwise((500 + F.col("p_partkey") % 300).cast("string"))
    return table(spark, d, "part").select("p_partkey", cl.dewey_to_udc(dewey).alias("udc"))


@query("agreement_report", "select case when a = b then 'exacto' when a // 10 = b // 10 then 'misma_area' else 'difiere' end as state, count(*) as n from (select 10 + p_partkey % 80 as a, 10 + p_size as b from part) group by 1")
def agreement_report(spark: SparkSession, d: str) -> Row:
    state = resolve.agreement((10 + F.col("p_partkey") % 80).cast("string"), (10 + F.col("p_size")).cast("string"))
    return table(spark, d, "part").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("marc_records", "select p_partkey, p_name from part")
def marc_records(spark: SparkSession, d: str) -> Row:
    """Records of parts as books, with the title read back from the XML."""
    xml = marc.record({"title": F.col("p_name"), "publisher": F.col("p_brand"), "pages": F.col("p_size")})
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(xml, r'tag="245"[^>]*><subfield code="a">([^<]*)<', 1).alias("p_name"))


@query("guarded_delete", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def guarded_delete(spark: SparkSession, d: str) -> Row:
    return merge.delete_unreferenced(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders").where("o_totalprice > 300000"), "o_custkey")


@query("unique_key_conflicts", "select p_partkey, case when row_number() over (partition by p_name order by p_partkey) = 1 then p_name end as p_name, row_number() over (partition by p_name order by p_partkey) > 1 as revision_requerida from part")
def unique_key_conflicts(spark: SparkSession, d: str) -> Row:
    return merge.unique_or_flagged(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "p_name", "revision_requerida")


@query("bulk_update", "select o_orderkey, case when o_orderstatus = 'F' and o_totalprice < 50000 then 'X' else o_orderstatus end as o_orderstatus from orders")
def bulk_update(spark: SparkSession, d: str) -> Row:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return merge.set_where(rows, F.expr("o_orderstatus = 'F' and o_totalprice < 50000"), {"o_orderstatus": F.lit("X")}).drop("o_totalprice")


@query("retained_events", "select event_id from events where ts >= (select max(ts) from events) - interval 10 day")
def retained_events(spark: SparkSession, d: str) -> Row:
    events = table(spark, d, "events")
    now = events.agg(F.max("ts")).first()[0]
    return activity.retained(events, now, 10).select("event_id")


@query("debounced_bursts", """
with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
g as (select *, sum(case when before is null or ts >= before + interval 6 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as burst from e)
select user_id, count(*) as n, min(ts) as start from g group by user_id, burst
""")
def debounced_bursts(spark: SparkSession, d: str) -> Row:
    return activity.debounced(table(spark, d, "events"), "user_id", "6 hours").select("user_id", "n", "start")


@query("subject_search", "select distinct p_type from part where contains(lower(p_type), 'steel') or starts_with(lower(p_type), 'promo') order by 1 limit 30")
def subject_search(spark: SparkSession, d: str) -> Row:
    kinds = table(spark, d, "part").select("p_type").distinct()
    hit = catalog.substring_condition("steel", [F.col("p_type")]) | F.lower("p_type").startswith("promo")
    return kinds.where(hit).orderBy(model.natural_key(F.col("p_type"))).limit(30)


@query("files_by_format", "select case when page_id % 3 = 0 then 'pdf' when page_id % 3 = 1 then 'epub' else 'desconocido' end as kind, count(*) as n from pages group by 1")
def files_by_format(spark: SparkSession, d: str) -> Row:
    name = F.concat(F.lit("dir.x/f"), F.element_at(F.array(F.lit(".PDF"), F.lit(".epub"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))
    kind = cl.file_format(F.element_at(F.split(name, "/"), -1))
    return table(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
