"""Images matched to documents, and name patterns of folders, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import covers, patterns
from shelfspark.plans.registry import query, table

Row = DataFrame
#: A document's name and, for an image, the same with a letter that a file system lost: each ``o``, or each ``e`` of dear parts.
_NAME = "replace(p_name, ' ', '') || lower(replace(p_brand, '#', '')) || lower(p_type) || cast(p_size as {text})"


@query("images_to_documents", f"""
with d as (select p_partkey as id, {_NAME.format(text="varchar")} as name from part),
i as (select p_partkey as id, replace({_NAME.format(text="varchar")}, case when p_retailprice > 1000 then 'e' else 'o' end, '?') as name from part),
a as (select distinct name as a from i), b as (select name as b, count(*) as k, min(id) as doc from d group by 1),
ok as (
  select a, b, k, doc from a, b where length(a) = length(b) and
    len(list_filter(range(1, length(a) + 1), lambda p: a[p] <> b[p] and a[p] <> '?' and b[p] <> '?')) = 0 and len(list_filter(range(1, length(a) + 1), lambda p: a[p] <> b[p])) <= greatest(1, length(a) // 4)),
f as (select a, sum(k) as n, min(doc) as doc from ok group by 1),
r as (select i.id, coalesce(n, 0) as n, case when n = 1 then doc end as doc from i left join f on f.a = i.name),
c as (select doc, count(*) as claims from r where doc is not null group by 1),
s as (select id as image, case when n = 0 then 'sin_coincidencia' when n > 1 or claims > 1 then 'ambiguo' else 'emparejado' end as state, r.doc, n from r left join c on c.doc = r.doc)
select image, state, case when state = 'emparejado' then doc end as doc, cast(n as bigint) as n from s
""")
def images_to_documents(spark: SparkSession, d: str) -> Row:
    parts = table(spark, d, "part")
    name = F.expr(_NAME.format(text="string"))
    docs = parts.select(F.col("p_partkey").alias("_id"), name.alias("name"))
    lost = F.when(F.col("p_retailprice") > 1000, F.replace(name, F.lit("e"), F.lit("?"))).otherwise(F.replace(name, F.lit("o"), F.lit("?")))
    return covers.matched(parts.select(F.col("p_partkey").alias("_id"), lost.alias("name")), docs)


@query("folder_separators", """
with m as (select p_type as folder, case when p_size > 25 then p_name || ' - ' || p_brand when p_size > 10 then replace(p_name, ' ', '_') || '.' || p_brand else p_name end as rest from part),
g as (select folder, count(*) as n, count(*) filter (where contains(rest, '_')) * 2 >= count(*) as blank from m group by 1),
s as (select * from (values (0, '.', 3), (1, ' - ', 4), (2, ' — ', 4), (3, ' · ', 4), (4, '·', 2), (5, '_', 1), (6, '-', 1), (7, ' ', 0)) v(i, sep, w)),
k as (
  select m.folder, n, blank, i, sep, w, len(list_filter(list_transform(case when sep = ' ' then regexp_split_to_array(rest, '\\s+') else string_split(rest, sep) end, lambda x: trim(x)), lambda x: x <> '')) as k
  from m join g using (folder), s where not (blank and sep in ('_', ' '))),
c as (select folder, i, sep, w, k, count(*) as c from k where k > 0 group by all),
md as (select folder, i, sep, w, max(struct_pack(c := c, k := k)) as m, sum(c) as t from c group by all),
b as (select *, round(m.c / t * 100 + w * 3 + least(m.k, 8), 9) as score from md where m.k >= 2 qualify row_number() over (partition by folder order by score desc, i) = 1)
select folder, n, sep as separator, coalesce(m.k, 1)::int as pieces, round(m.c / t, 6) as share from g left join b using (folder)
""")
def folder_separators(spark: SparkSession, d: str) -> Row:
    """The majority count: which separator cuts a folder's names most alike."""
    rest = F.when(F.col("p_size") > 25, F.concat_ws(" - ", "p_name", "p_brand")).when(F.col("p_size") > 10, F.concat_ws(".", F.translate("p_name", " ", "_"), "p_brand")).otherwise(F.col("p_name"))
    return patterns.separators(table(spark, d, "part").select(F.col("p_type").alias("folder"), rest.alias("rest")), "folder").select("folder", "n", "separator", "pieces", F.round("share", 6).alias("share"))


@query("fields_by_pattern", """
select p_partkey, p_name as titulo, 1900 + p_size as anio_edicion, 'LO' as coleccion_nombre, p_size as coleccion_numero, p_brand || ' Press' as editorial from part
""")
def fields_by_pattern(spark: SparkSession, d: str) -> Row:
    """Code and number, publisher, title and year out of file names, by the pattern of their folder."""
    name = F.concat(F.lit("LO"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" - "), "p_brand", F.lit(" Press - "), "p_name", F.lit(" ("), (F.col("p_size") + 1900).cast("string"), F.lit(").epub"))
    files = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("carpeta"), name.alias("nombre"))
    return patterns.applied(files, patterns.detected(files)).select("p_partkey", "titulo", "anio_edicion", "coleccion_nombre", "coleccion_numero", "editorial")
