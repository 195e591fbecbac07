"""Reports and rules of upkeep, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import reports
from shelfspark.plans.registry import query, table

Row = DataFrame
_CHECK = "cast((10 - (38 + " + " + ".join(f"cast(substr(b, {i}, 1) as int) * {1 if i % 2 else 3}" for i in range(4, 13)) + ") % 10) % 10 as string)"
_BOOKS = f"""
select o_orderkey as _id, titulo, b || {_CHECK} as isbn, nombre_archivo from (
  select o_orderkey, p_name || ' ' || p_type as titulo, '978' || lpad(cast(cast(floor(o_custkey / 2) as int) as string), 9, '0') as b, case when o_orderstatus = 'F' then lower(p_name) || '.pdf' when o_orderstatus = 'O' then 'scan 12.pdf' end as nombre_archivo
  from {{orders}} join {{part}} on p_partkey = o_custkey) x
"""
_AUTHORITY = f"select b || {_CHECK} as isbn, p_name as titulo from (select p_name, '978' || lpad(cast(p_partkey as string), 9, '0') as b from {{part}} where p_size > 10) x"


def books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    for name in ("orders", "part"):
        table(spark, d, name).createOrReplaceTempView(f"_report_{name}")
    names = {"orders": "_report_orders", "part": "_report_part"}
    return spark.sql(_BOOKS.format(**names)), spark.sql(_AUTHORITY.format(**names))


_BOOKS_SQL = f"with o as ({_BOOKS.format(orders='orders', part='part')}), a as ({_AUTHORITY.format(orders='orders', part='part')})"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3))"
_ALIKE = "(len(list_intersect({x}, {y})) >= 0.6 * least(len({x}), len({y})) and least(len({x}), len({y})) > 0)"


@query("isbn_audit", f"""{_BOOKS_SQL},
k as (select isbn, count(*) as k from o group by isbn),
m as (select o._id, min(case when a.titulo is not null then not {_ALIKE.format(x=_WORDS.format('o.titulo'), y=_WORDS.format('a.titulo'))} end) as far from o left join a using (isbn) group by o._id)
select 'repeticiones' as parte, case when k <= 4 then cast(k as string) when k <= 10 then '5-10' when k <= 50 then '11-50' else '51+' end as clave, count(*) as n from k group by all
union all select 'sospechosos', isbn, k from k where k > 4
union all select 'autoridad', case when far is null then 'ausente' when far then 'difiere' else 'coincide' end, count(*) from m group by all
""")
def isbn_audit(spark: SparkSession, d: str) -> Row:
    return reports.isbn_audit(*books(spark, d))


@query("title_corrections", f"""{_BOOKS_SQL},
t as (select isbn, min(titulo) as t from a group by isbn), j as (select o.*, t from o join t using (isbn))
select _id as o_orderkey, case when nombre_archivo is not null and {_ALIKE.format(x=_WORDS.format("regexp_replace(nombre_archivo, '[.]pdf$', '')"), y=_WORDS.format('t'))} then 'aplicar' else 'revisar' end as accion, t as titulo
from j where lower(titulo) <> lower(t)
""")
def title_corrections(spark: SparkSession, d: str) -> Row:
    """Titles go to the authority's if the file name bears it out."""
    return reports.title_corrections(*books(spark, d)).withColumnRenamed("_id", "o_orderkey")


@query("pending_codes", """
with d as (select case when p_size > 10 then '000' end as cdu, case when p_size > 15 then p_type || p_size end as dewey, case when p_size < 40 then 'P' || p_size end as lcc, case when p_retailprice > 1500 then 'w' end as obra from part),
p as (select * from d where obra is null),
c as (select distinct 'dewey' as sistema, dewey as codigo from p where dewey is not null union select distinct 'lcc', lcc from p where dewey is null and lcc is not null)
select sistema, codigo from c where not exists (select 1 from supplier where sistema = 'lcc' and codigo = 'P' || cast(s_suppkey as int))
""")
def pending_codes(spark: SparkSession, d: str) -> Row:
    """Codes without a crosswalk that nobody has taught; suppliers stand for what was learnt."""
    size = F.col("p_size").cast("string")
    docs = table(spark, d, "part").select(
        F.when(F.col("p_size") > 10, "000").alias("cdu"), F.when(F.col("p_size") > 15, F.concat("p_type", size)).alias("dewey"), F.when(F.col("p_size") < 40, F.concat(F.lit("P"), size)).alias("lcc"),
        F.when(F.col("p_retailprice") > 1500, "w").alias("obra"), F.lit(None).cast("boolean").alias("cdu_manual"),
    )
    learnt = table(spark, d, "supplier").select(F.lit("lcc").alias("sistema_origen"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("codigo_origen"))
    return reports.pending_codes(docs, learnt)


@query("missing_descriptions", """
with u as (select distinct 'cdu' as sistema, cast(p_size as string) as codigo from part union select distinct 'dewey', cast(p_partkey as string) from part union select distinct 'lcc', p_type from part where p_type <> 'PROMO')
select * from u where not (sistema = 'cdu' and codigo in (select cast(n_nationkey as string) from nation)) and not (sistema = 'dewey' and codigo in (select cast(s_suppkey as string) from supplier))
""")
def missing_descriptions(spark: SparkSession, d: str) -> Row:
    docs = table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(" literal")).alias("cdu"), F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("dewey"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("lcc"))
    text = lambda name, c: table(spark, d, name).select(F.lit("dewey").alias("sistema"), F.col(c).cast("string").alias("codigo"))
    return reports.missing_descriptions(docs, text("nation", "n_nationkey"), text("supplier", "s_suppkey"))


@query("enrichable_people", "select s_suppkey, s_name from supplier where (s_acctbal < 5000 or s_nationkey > 10) and s_suppkey in (select l_suppkey from lineitem where l_discount > 0.05)")
def enrichable_people(spark: SparkSession, d: str) -> Row:
    docs = table(spark, d, "lineitem").where("l_discount > 0.05").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("autores"))
    people = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("nombre"), F.when(F.col("s_acctbal") >= 5000, "b").alias("biografia"), F.when(F.col("s_nationkey") <= 10, "f").otherwise("").alias("foto"))
    return reports.enrichable_people(docs, people).select(F.col("_id").alias("s_suppkey"), F.col("nombre").alias("s_name"))


@query("units_of_folders", """
with f as (select p_type as folder, case when p_size > 30 then p_name || ' (2).pdf' when p_size > 10 then p_name || '.pdf' else p_name || ' ' || p_size || '.jpg' end as name from part),
k as (select * from f a where not (name like '% (2).pdf' and exists (select 1 from f b where b.folder = a.folder and b.name = replace(a.name, ' (2)', ''))))
select folder, case when name like '%.jpg' then 'imagenes' else 'f:' || name end as unit, count(*) as files from k group by all
""")
def units_of_folders(spark: SparkSession, d: str) -> Row:
    """Copies beside their original go; a folder's loose images are one unit."""
    name = F.when(F.col("p_size") > 30, F.concat("p_name", F.lit(" (2).pdf"))).when(F.col("p_size") > 10, F.concat("p_name", F.lit(".pdf"))).otherwise(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".jpg")))
    files = table(spark, d, "part").select(F.col("p_type").alias("carpeta"), name.alias("nombre"))
    return reports.units(files).select(F.col("carpeta").alias("folder"), F.col("unidad").alias("unit"), F.col("ficheros").alias("files"))


@query("kinds_by_pages", """
select p_partkey, case when p_type = 'PROMO' or p_size = 0 then null when p_type = 'ECONOMY' and p_size < 12 then 'libro/papel' when p_type <> 'ECONOMY' and p_size < 20 and p_retailprice <= 1500 then case when p_brand = 'Brand#1' then 'articulo/' else 'capitulo/' end end as kind from part
""")
def kinds_by_pages(spark: SparkSession, d: str) -> Row:
    c = F.col
    kind = reports.by_pages(c("p_size"), c("p_type") == "ECONOMY", F.when(c("p_type") == "PROMO", "revista").otherwise("libro"), F.when(c("p_brand") == "Brand#1", "10.1/x"), c("p_retailprice") > 1500, F.lit(False))
    return table(spark, d, "part").select("p_partkey", F.when(kind.isNotNull(), F.concat(kind["tipo_recurso"], F.lit("/"), F.coalesce(kind["formato"], F.lit("")))).alias("kind"))


@query("filter_activity", "select event_id, user_id from events where event_type in ('error', 'click') and user_id = 8 and (contains(props, '6') or contains(event_type, '6')) and ts between timestamp '2024-01-01' and timestamp '2024-06-30'")
def filter_activity(spark: SparkSession, d: str) -> Row:
    """Kinds, one user, a text in nested fields, and a time range with both ends."""
    rows = table(spark, d, "events")
    found = reports.activity(rows.withColumn("u", F.col("user_id").cast("string")), kinds=["error", "click"], user="8", pattern="6", nested=["props", "event_type"], since="2024-01-01", until="2024-06-30", kind_col="event_type", user_col="u")
    return found.select("event_id", "user_id")
