"""Identity, works, issues and numbers of incoming records, on the driver's tables: orders are records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import identity
from shelfspark.plans.registry import query, table

Row = DataFrame
_RECORDS = """
select o_orderkey as _id, case o_orderstatus when 'F' then 'libro' when 'O' then 'revista' else 'articulo' end as tipo_recurso, case when o_totalprice > 50000 then cast(cast(floor(o_totalprice / 60) as int) as string) end as hash_contenido,
  case when o_orderpriority <> '5-LOW' then substr(o_orderpriority, 1, 1) end as nombre_archivo, case when o_custkey < 200 then 'w' || o_custkey end as obra, case when o_totalprice < 300000 then cast(cast(floor(o_totalprice / 100000) as int) as string) end as volumen_numero,
  case when o_custkey < 900 then 's' || cast(cast(floor(o_custkey / 40) as int) as string) end as coleccion, case when o_totalprice < 250000 then cast(cast(floor(o_totalprice / 1000) as int) as string) end as clave_numero, 't' || o_custkey as titulo, cast(year(o_orderdate) as int) as anio_edicion,
  case when month(o_orderdate) < 7 then cast(month(o_orderdate) as int) end as mes_publicacion, 'd' || o_custkey as doi, 'i' || cast(cast(floor(o_custkey / 3) as int) as string) as isbn, substr(o_orderpriority, 1, 1) as format
from {orders}
"""


def records(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("_records_orders")
    return spark.sql(_RECORDS.format(orders="_records_orders")).withColumn("formatos", F.array("format"))


@query("identity_cascade", f"""
with r as ({_RECORDS.format(orders="orders")}),
k as (
  select *, case when obra is not null and volumen_numero is not null then 'v|' || obra || '|' || volumen_numero
    when tipo_recurso = 'revista' then case when coleccion is not null then 'n|' || coleccion || '|' || clave_numero when mes_publicacion is not null then 'm|' || titulo || '|' || anio_edicion || '|' || mes_publicacion else 'y|' || titulo || '|' || anio_edicion end
    when tipo_recurso = 'articulo' then 'd|' || doi when obra is null then 'i|' || isbn || '|' || format end as key,
    case when hash_contenido is not null then min(_id) over (partition by hash_contenido) else _id end as first from r),
h as (select k.*, f.nombre_archivo as first_name from k join k f on f._id = k.first),
a as (select * from h where first = _id and key is not null),
o as (select key, min(_id) as owner, arg_min(nombre_archivo, _id) filter (where nombre_archivo is not null) as owner_name, min(_id) filter (where nombre_archivo is not null) as named_at from a group by key),
j as (
  select a._id, owner from a join o using (key)
  where a._id <> owner and (nombre_archivo = owner_name or (nombre_archivo is null and (not starts_with(key, 'i|') or named_at is null or named_at > a._id))))
select h._id as o_orderkey, coalesce(owner, first) as target,
  case when first <> h._id then case when nombre_archivo is not distinct from first_name then 'actualizacion' else 'duplicado_exacto' end when owner is not null then 'actualizacion' else 'insercion' end as operacion
from h left join j on j._id = h.first
""")
def identity_cascade(spark: SparkSession, d: str) -> Row:
    return identity.identified(records(spark, d)).withColumnRenamed("_id", "o_orderkey")


@query("volume_isbns", f"""
with r as ({_RECORDS.format(orders="orders")}), o as (select isbn, arg_min(struct_pack(id := _id, w := obra, v := volumen_numero), _id) as o from r group by isbn),
x as (select r._id, r.isbn, obra is not null and o.id <> r._id and not coalesce(o.w = obra and o.v = volumen_numero, false) as taken from r join o using (isbn))
select _id as o_orderkey, case when not taken then isbn end as isbn, taken as review from x
""")
def volume_isbns(spark: SparkSession, d: str) -> Row:
    """Volumes lose numbers that belong to others."""
    out = identity.safe_volume_isbns(records(spark, d).withColumn("isbn_obra", F.lit(None).cast("string")))
    return out.select(F.col("_id").alias("o_orderkey"), "isbn", F.col("revision_requerida").alias("review"))


@query("inherited_marks", "select o_orderkey, coalesce(o_totalprice > 450000, false) or c_mktsegment = 'BUILDING' or c_nationkey in (select n_nationkey from nation where n_regionkey = 1) as marked from orders join customer on o_custkey = c_custkey")
def inherited_marks(spark: SparkSession, d: str) -> Row:
    docs = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_custkey").alias("obra"), F.col("c_nationkey").alias("coleccion"), (F.col("o_totalprice") > 450000).alias("nsfw"))
    works = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), (F.col("c_mktsegment") == "BUILDING").alias("nsfw"))
    series = table(spark, d, "nation").select(F.col("n_nationkey").alias("_id"), (F.col("n_regionkey") == 1).alias("nsfw"))
    return identity.inherited_mark(docs, works, series).select("o_orderkey", F.col("nsfw").alias("marked"))


@query("resolved_works", """
with w as (select 'w' || c_custkey as _id, c_name as titulo, case when c_acctbal > 0 then 'i' || c_custkey end as isbn_obra, cast(c_nationkey as int) as total from customer where c_nationkey < 20),
r as (select o_orderkey, case when o_orderstatus = 'F' then 'i' || o_custkey end as i, case when o_orderstatus <> 'P' then c_name end as t, cast(floor(o_totalprice / 10000) as int) as total from orders join customer on o_custkey = c_custkey),
x as (
  select r.*, coalesce(a._id, b._id, case when coalesce(i, t) is not null then 'new:' || sha1(coalesce(i, t)) end) as obra from r left join w a on a.isbn_obra = r.i left join w b on b.titulo = r.t),
g as (select obra, max(total) as total, count(*) as n from x where obra is not null group by 1)
select g.obra, greatest(g.total, coalesce(w.total, 0)) as total, n from g left join w on w._id = g.obra
""")
def resolved_works(spark: SparkSession, d: str) -> Row:
    """Rows that name a work by number or title; totals only rise."""
    customers = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    works = customers.where("c_nationkey < 20").select(F.concat(F.lit("w"), "c_custkey").alias("_id"), F.col("c_name").alias("titulo"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("i"), "c_custkey")).alias("isbn_obra"), none.alias("editorial"), none.alias("coleccion"), none.alias("cdu"), F.col("c_nationkey").cast("int").alias("total"))
    rows = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("i"), "o_custkey")).alias("isbn_obra"), F.when(F.col("o_orderstatus") != "P", F.col("c_name")).alias("titulo_obra"),
        none.alias("editorial"), none.alias("coleccion"), none.alias("cdu"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("total"),
    )
    out, after = identity.resolved_works(rows, works)
    return out.where("obra is not null").groupBy("obra").agg(F.count("*").alias("n")).join(after.select(F.col("_id").alias("obra"), "total"), "obra").select("obra", "total", "n")


@query("issue_inventory", f"""
with r as ({_RECORDS.format(orders="orders")}), l as (select coleccion, clave_numero as k, max(_id) as id from r where coleccion is not null and clave_numero is not null group by 1, 2),
a as (select coleccion, string_agg(k || ':' || id, ',' order by cast(k as int)) as numbers, count(*) as n from l group by 1), b as (select coleccion, count(*) as loose from r where coleccion is not null and clave_numero is null group by 1)
select coalesce(a.coleccion, b.coleccion) as series, coalesce(numbers, '') as numbers, coalesce(n, 0)::int as present, coalesce(loose, 0)::int as loose from a full join b on a.coleccion = b.coleccion
""")
def issue_inventory(spark: SparkSession, d: str) -> Row:
    out = identity.issues(records(spark, d))
    return out.select(F.col("coleccion").alias("series"), F.array_join(F.transform("numeros", lambda x: F.concat_ws(":", x["clave"], x["_id"].cast("string"))), ",").alias("numbers"), F.col("presentes").alias("present"), F.size("sin_fecha").alias("loose"))


@query("auto_number_members", f"""
with r as ({_RECORDS.format(orders="orders")}), x as (select *, max(cast(clave_numero as int)) over (partition by coleccion) as most, row_number() over (partition by coleccion, clave_numero is null order by _id) as k from r)
select _id as o_orderkey, case when clave_numero is null and coleccion is not null then cast(coalesce(most, 0) + k as string) else clave_numero end as number, clave_numero is null and coleccion is not null as auto from x
""")
def auto_number_members(spark: SparkSession, d: str) -> Row:
    """Members without a number go on after their own series' largest."""
    out = identity.numbered_after(records(spark, d).withColumn("coleccion_numero", F.col("clave_numero")))
    return out.select(F.col("_id").alias("o_orderkey"), F.col("coleccion_numero").alias("number"), "auto")
