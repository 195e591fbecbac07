"""Numbers of groups and surgery on groups, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import groups, numbers, resolve
from shelfspark.plans.registry import query, table

Row = DataFrame


@query("next_free_number", "with t as (select l_suppkey, l_partkey as n, row_number() over (partition by l_suppkey order by l_partkey) as m from (select distinct l_suppkey, l_partkey from lineitem where l_partkey >= 1)) select l_suppkey, coalesce(min(case when n <> m then m end), max(m) + 1) as free from t group by 1")
def next_free_number(spark: SparkSession, d: str) -> Row:
    """The least part number that a supplier has not delivered."""
    return numbers.next_free(table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("number_gaps", """
with t as (select distinct l_suppkey, l_partkey as n from lineitem where l_partkey >= 1), p as (select l_suppkey, n, lag(n, 1, 0) over (partition by l_suppkey order by n) as before from t)
select l_suppkey, before + 1 as first, n - 1 as last from p where n > before + 1
""")
def number_gaps(spark: SparkSession, d: str) -> Row:
    return numbers.gaps(table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("displaced_numbers", """
with recursive v as (
  select o_orderkey, o_custkey as g, cast(floor(o_totalprice / 20000) as bigint) + 1 as n, o_orderstatus <> 'F' as auto from orders),
c as (select g, n, bool_or(not auto) as ed, min(o_orderkey) filter (where auto) as first from v group by 1, 2),
j as (select v.*, not auto or (not ed and o_orderkey = first) as stays from v join c using (g, n)),
l as (select *, row_number() over (partition by g order by n, o_orderkey) as i from j where not stays),
t as (select g, list(distinct n) as taken from j where stays group by g),
w as (
  select l.g, l.i, l.o_orderkey, list_min(list_filter(range(l.n + 1, l.n + 200), lambda x: not list_contains(t.taken, x))) as to_n, t.taken from l join t using (g) where i = 1
  union all
  select l.g, l.i, l.o_orderkey, list_min(list_filter(range(l.n + 1, l.n + 200), lambda x: not list_contains(w.taken, x) and x > w.to_n)), list_append(w.taken, w.to_n) from w join l on l.g = w.g and l.i = w.i + 1)
select j.o_orderkey, j.g as o_custkey, coalesce(w.to_n, j.n) as number, w.to_n is not null as moved from j left join w using (o_orderkey)
""")
def displaced_numbers(spark: SparkSession, d: str) -> Row:
    """Orders as volumes of customers: printed numbers stay, automatic ones give way."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), "o_custkey", (F.floor(F.col("o_totalprice") / 20000) + 1).cast("long").alias("number"), (F.col("o_orderstatus") != "F").alias("auto"))
    return numbers.placed(orders, "o_custkey", "number", "auto").withColumnRenamed("_id", "o_orderkey")


@query("volume_inventory", """
with v as (select l_orderkey, l_linenumber as n, min(l_partkey) as p from lineitem where l_returnflag <> 'N' group by 1, 2),
o as (select o_orderkey, greatest(coalesce(max(n), 0), case when o_orderstatus = 'F' then 6 else 0 end) as total from orders left join v on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus),
e as (select o_orderkey, unnest(range(1, total + 1)) as number from o)
select o_orderkey, number, p as l_partkey from e left join v on l_orderkey = o_orderkey and n = number
""")
def volume_inventory(spark: SparkSession, d: str) -> Row:
    """Every number from 1 to the total, with its volume or null; returned and accepted lines are there, open ones are missing."""
    volumes = table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("obra"), F.col("l_linenumber").cast("long").alias("numero"), F.col("l_partkey").alias("_id")).distinct()
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("obra"), F.when(F.col("o_orderstatus") == "F", 6).alias("total"))
    return resolve.listed(resolve.inventory(volumes, works)).select(F.col("obra").alias("o_orderkey"), F.col("numero").alias("number"), F.col("_id").alias("l_partkey"))


@query("union_by_key", """
with x as (select l_orderkey, l_suppkey as k, l_quantity as v, l_returnflag = 'N' as late, l_linenumber, l_partkey from lineitem),
f as (select *, row_number() over (partition by l_orderkey, k order by late, l_linenumber, l_partkey, v) as r, row_number() over (partition by l_orderkey order by late, l_linenumber, l_partkey, v) as place from x)
select l_orderkey, string_agg(k || ':' || cast(v as int), ',' order by place) as united from f where r = 1 group by 1
""")
def union_by_key(spark: SparkSession, d: str) -> Row:
    """Structs of a second list join those of a first unless their key is there."""
    item = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("v"), F.col("l_suppkey").alias("k"))
    side = lambda late: F.array_sort(F.collect_list(F.when((F.col("l_returnflag") == "N") == F.lit(late), item)))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(side(False).alias("a"), side(True).alias("b"))
    united = numbers.union_by(F.col("a"), F.col("b"), "k")
    return rows.select("l_orderkey", F.array_join(F.transform(united, lambda x: F.concat_ws(":", x["k"].cast("string"), x["v"].cast("int").cast("string"))), ",").alias("united"))


@query("merged_chains", """
with c as (select c_custkey, c_name, max(case when c_mktsegment <> 'BUILDING' or c_custkey = 0 then c_custkey end) over (order by c_custkey) as root from customer),
n as (select c.c_custkey, c.root, r.c_name from c join customer r on r.c_custkey = c.root)
select o_orderkey, root as obra, c_name as obra_titulo from orders join n on o_custkey = n.c_custkey
""")
def merged_chains(spark: SparkSession, d: str) -> Row:
    """Each customer of a segment is merged into the one before, which may be merged itself."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("nombre"), "c_mktsegment")
    merges = customers.where("c_mktsegment = 'BUILDING' and _id > 0").select(F.col("_id").alias("old"), (F.col("_id") - 1).alias("new"))
    docs = table(spark, d, "orders").join(customers.select(F.col("_id").alias("o_custkey"), "nombre"), "o_custkey").select("o_orderkey", F.col("o_custkey").alias("obra"), F.col("nombre").alias("obra_titulo"))
    return groups.merge_groups(docs, customers, "obra", merges)[0]


@query("expelled_documents", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey) or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice <= 300000)")
def expelled_documents(spark: SparkSession, d: str) -> Row:
    """Customers left after the dear orders leave theirs: those that had none stay, those that lose their last one go."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("obra"), "o_totalprice")
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"))
    return groups.expelled(docs, own, "obra", docs.where("o_totalprice > 300000"))[1].select(F.col("_id").alias("c_custkey"))


@query("undone_change", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def undone_change(spark: SparkSession, d: str) -> Row:
    """Two changes in one window, taken back: every row is as it was."""
    before = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    once = before.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 200000, F.lit(None)).otherwise(F.col("o_orderstatus")))
    twice = once.withColumn("o_totalprice", F.when(F.col("o_orderstatus").isNull(), F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    at = lambda s: F.to_timestamp(F.lit(s))
    columns = ["o_orderstatus", "o_totalprice"]
    log = groups.recorded(before, once, columns, at("2026-01-01 10:00:00.2"), "o_orderkey").unionByName(groups.recorded(once, twice, columns, at("2026-01-01 10:00:00.7"), "o_orderkey"))
    return groups.undone(twice, log, "2026-01-01 10:00:00", "2026-01-01 10:00:01", before.where("o_totalprice > 200000").count(), "o_orderkey")
