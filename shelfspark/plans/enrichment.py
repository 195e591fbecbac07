"""Source ladder, enrichment, publishers and spellings, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.publishers import is_false_publisher
from shelfspark.operators import enrich, spelling
from shelfspark.plans.registry import query, table

Row = DataFrame
#: Each line of an order is what one source says of it; the parts' columns are the fields.
_SAID = """
select l_orderkey as _id, case l_returnflag when 'R' then 'openlibrary' when 'A' then 'fichero' when 'N' then 'cip' end as fuente, case when l_quantity > 20 then p_name when l_quantity > 15 then ' ' end as titulo,
  case when l_discount > 0.03 then p_brand end as editorial, case when l_tax > 0.05 then 1900 + p_size end as anio_edicion
from {lineitem} join {part} on l_partkey = p_partkey
"""


def said(spark: SparkSession, d: str) -> DataFrame:
    for name in ("lineitem", "part"):
        table(spark, d, name).createOrReplaceTempView(f"_said_{name}")
    return spark.sql(_SAID.format(lineitem="_said_lineitem", part="_said_part"))


_LADDER = f"""
with c as ({_SAID.format(lineitem="lineitem", part="part")}),
r as (select *, case fuente when 'cip' then 0 when 'fichero' then 1 else 2 end as k from c),
b as (
  select _id, min(struct_pack(k := k, v := titulo, f := fuente)) filter (where trim(titulo) <> '') as t, min(struct_pack(k := k, v := editorial, f := fuente)) filter (where trim(editorial) <> '' and fuente <> 'cip') as e,
    min(struct_pack(k := k, v := anio_edicion, f := fuente)) filter (where anio_edicion is not null) as y from r group by _id)
"""


@query("source_ladder", f"""{_LADDER}
select _id as o_orderkey, t.v as titulo, e.v as editorial, y.v as anio_edicion, concat_ws(',', 'titulo:' || t.f, 'editorial:' || e.f, 'anio_edicion:' || y.f) as procedencia from b
""")
def source_ladder(spark: SparkSession, d: str) -> Row:
    """The best source of each field, and which it was; publishers aren't taken from cataloguing blocks."""
    found = enrich.ladder(said(spark, d), ["titulo", "editorial", "anio_edicion"], only={"editorial": ("fichero", "openlibrary")})
    of = lambda c: F.when(F.map_contains_key("procedencia", c), F.concat(F.lit(f"{c}:"), F.col("procedencia")[c]))
    return found.select(F.col("_id").alias("o_orderkey"), "titulo", "editorial", "anio_edicion", F.concat_ws(",", of("titulo"), of("editorial"), of("anio_edicion")).alias("procedencia"))


_OWN = """
select o_orderkey as _id, case o_orderstatus when 'F' then 'untitled' when 'O' then o_orderpriority end as titulo, case when o_totalprice > 300000 then 'ePub Libre' when o_totalprice > 200000 then 'Own' end as editorial,
  case when o_totalprice < 50000 then 1800 end as anio_edicion, case when o_orderpriority = '5-LOW' then '0306406152' when o_orderpriority = '1-URGENT' then '123' end as isbn
from {orders}
"""


@query("enriched_records", f"""{_LADDER}, o as ({_OWN.format(orders="orders")}),
j as (select o._id, o.titulo, o.editorial as oe, o.anio_edicion as oy, o.isbn as oi, t.v as nt, e.v as ne, y.v as ny from o left join b using (_id)),
x as (
  select _id, case when (titulo is null or titulo = 'untitled') and nt is not null then nt else titulo end as titulo, case when (oe = 'ePub Libre' or oe is null) and ne is not null then ne else oe end as editorial,
    coalesce(oy, ny) as anio_edicion, case when oi = '0306406152' then oi end as isbn from j)
select _id as o_orderkey, titulo, editorial, cast(anio_edicion as int) as anio_edicion, isbn, case when titulo is not null and titulo <> 'untitled' and isbn is not null then 'completado' else 'pendiente' end as estado from x
""")
def enriched_records(spark: SparkSession, d: str) -> Row:
    """Doubtful titles, false publishers and gaps give way to what was found; invalid numbers go."""
    table(spark, d, "orders").createOrReplaceTempView("_own_orders")
    docs = spark.sql(_OWN.format(orders="_own_orders")).withColumns({"tipo_recurso": F.lit("libro"), "autores": F.lit(None).cast("array<string>"), **{c: F.lit(None).cast("string") for c in ("issn", "cdu", "idioma", "coleccion_nombre")}})
    found = enrich.ladder(said(spark, d), ["titulo", "editorial", "anio_edicion"], only={"editorial": ("fichero", "openlibrary")})
    out = enrich.enriched(docs, found, false_publisher=is_false_publisher(F.col("editorial")))
    return out.select(F.col("_id").alias("o_orderkey"), "titulo", "editorial", F.col("anio_edicion").cast("int").alias("anio_edicion"), "isbn", F.col("estado_verificacion").alias("estado"))


@query("publisher_transitions", f"""{_LADDER}, o as ({_OWN.format(orders="orders")})
select o.editorial as de, e.v as a, count(*) as n, string_agg(distinct e.f, ',' order by e.f) as fuentes from o join b using (_id) where e.v is not null and lower(coalesce(o.editorial, '')) <> lower(e.v) group by 1, 2
""")
def publisher_transitions(spark: SparkSession, d: str) -> Row:
    table(spark, d, "orders").createOrReplaceTempView("_own_orders")
    moved = enrich.transitions(enrich.reclassified(spark.sql(_OWN.format(orders="_own_orders")), said(spark, d), ("fichero", "openlibrary")))
    return moved.select("de", "a", "n", F.array_join("fuentes", ",").alias("fuentes"))


@query("author_spellings", """
with p as (select p_partkey as id, case when p_size > 40 then upper(p_name) when p_size > 25 then replace(p_name, 'i', 'í') else p_name end as n from part),
c as (select l_partkey as id, count(*) as c from lineitem group by 1),
r as (
  select p.id, strip_accents(lower(n)) as k, row_number() over (partition by strip_accents(lower(n)) order by (n = upper(n))::int, length(n) - length(replace(n, 'í', '')) desc, coalesce(c, 0) desc, p.id) as r from p left join c using (id))
select a.id as old, b.id as new from r a join r b on a.k = b.k and b.r = 1 where a.r > 1
""")
def author_spellings(spark: SparkSession, d: str) -> Row:
    """Part names as people, some in capitals, some with accents; lines are their documents."""
    name = F.when(F.col("p_size") > 40, F.upper("p_name")).when(F.col("p_size") > 25, F.translate("p_name", "i", "í")).otherwise(F.col("p_name"))
    people = table(spark, d, "part").select(F.col("p_partkey").alias("_id"), name.alias("nombre"))
    return spelling.spellings(people, table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("_id")).agg(F.count("*").alias("n")))


@query("fused_people", """
with k as (select distinct p_name as n from part), f as (select distinct a.p_name || ' ' || b.p_name as n from part a join part b on b.p_partkey = a.p_partkey + 1 union select distinct p_name || ' & ' || p_brand from part)
select n as name, case when contains(n, ' & ') then split_part(n, ' & ', 1) else split_part(n, ' ', 1) || ' ' || split_part(n, ' ', 2) end as first, case when not contains(n, ' & ') then split_part(n, ' ', 3) || ' ' || split_part(n, ' ', 4) end as last from f
""")
def fused_people(spark: SparkSession, d: str) -> Row:
    """Names of two parts in one, side by side or joined: the names that they are made of."""
    parts = table(spark, d, "part")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    both = parts.join(after, "p_partkey").select(F.concat_ws(" ", "p_name", "b").alias("nombre"))
    names = parts.select(F.col("p_name").alias("nombre")).unionByName(both).unionByName(parts.select(F.concat_ws(" & ", "p_name", "p_brand").alias("nombre"))).distinct()
    found = spelling.fused(names.select(F.col("nombre").alias("_id"), "nombre"))
    known = lambda i: F.when(~F.get("parts", F.lit(i)).startswith("new:"), F.get("parts", F.lit(i)))
    return found.select(F.col("old").alias("name"), known(0).alias("first"), known(1).alias("last"))
