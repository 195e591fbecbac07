"""Surgery on groups: merging works, series and people through chains, exploding, expelling, dropping what is empty, undoing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.clusters import written

#: What a document loses when it leaves a work or a series.
BELONGING = {"obra": ("obra", "obra_titulo", "volumen_numero", "volumen_titulo", "isbn_obra"), "coleccion": ("coleccion", "coleccion_nombre", "clave_numero", "coleccion_numero")}


def closed(merges: DataFrame) -> DataFrame:
    """``old, new, cycle`` of pairs ``old, new``, followed to the end: a to b and b to c give a to c.

    Pointers are doubled, so a chain of a million links takes twenty rounds.  An id with several targets goes to the smallest;
    one to itself is no merge.  Ids on a cycle, or that lead into one, have ``cycle`` true and a null target.
    """
    now = written(merges.where("old is not null and new is not null and old <> new").groupBy("old").agg(F.min("new").alias("new")))
    nodes, reach = now.count(), 1
    while True:
        step = now.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        joined = written(now.join(step, "new", "left").select("old", F.coalesce("_next", "new").alias("new"), F.col("_next").isNotNull().alias("_on")))
        reach *= 2
        if reach > 2 * nodes or not joined.where("_on").limit(1).count():
            break
        now = joined.select("old", "new")
    # past every chain's end, only what runs in circles still moves
    return joined.select("old", F.when(~F.col("_on"), F.col("new")).alias("new"), F.col("_on").alias("cycle"))


def remap(merges: DataFrame) -> DataFrame:
    """``old, new`` of the merges that can be carried out."""
    return closed(merges).where("not cycle").select("old", "new")


def _moved(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    own = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(own, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def merge_groups(docs: DataFrame, groups: DataFrame, kind: str, merges: DataFrame, *, name: str = "nombre") -> tuple[DataFrame, DataFrame]:
    """Documents of merged works or series in the group that they end in, under its name, and the groups that are left.

    A merge whose target doesn't exist is not carried out.
    """
    mapping = remap(merges).join(groups.select(F.col("_id").alias("new")), "new", "left_semi").select("old", "new")
    label = BELONGING[kind][1]
    named = mapping.join(groups.select(F.col("_id").alias("new"), F.col(name).alias("_name")), "new").select(F.col("old").alias(kind), "new", "_name")
    rows = docs.join(named, kind, "left").withColumns({label: F.when(F.col("new").isNotNull(), F.col("_name")).otherwise(F.col(label)), kind: F.coalesce("new", kind)}).select(docs.columns)
    return rows, groups.join(mapping.select(F.col("old").alias("_id")), "_id", "left_anti")


def merge_people(people: DataFrame, merges: DataFrame) -> DataFrame:
    """People after merges: the target keeps what it has, fills its gaps from the merged ones (smallest id first) and takes their names as spellings."""
    mapping = remap(merges).join(people.select(F.col("_id").alias("new")), "new", "left_semi")
    gone = people.join(mapping.select(F.col("old").alias("_id"), "new"), "_id")
    own = [c for c in people.columns if c not in ("_id", "nombre", "nombres_alternativos")]
    spelled = lambda d: F.array_union(F.array(d["nombre"]), F.coalesce(d["nombres_alternativos"], F.array().cast("array<string>")))
    took = gone.groupBy("new").agg(F.array_distinct(F.flatten(F.collect_list(spelled(gone)))).alias("_names"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_id"))).alias(f"_{c}") for c in own)).withColumnRenamed("new", "_id")
    rows = people.join(mapping.select(F.col("old").alias("_id")), "_id", "left_anti").join(took, "_id", "left")
    names = F.array_union(F.coalesce("nombres_alternativos", F.array().cast("array<string>")), F.coalesce("_names", F.array().cast("array<string>")))
    spellings = F.when(F.col("_names").isNull(), F.col("nombres_alternativos")).otherwise(F.array_sort(F.filter(names, lambda x: x.isNotNull() & (x != "") & ~x.eqNullSafe(F.col("nombre")))))
    return rows.withColumns({"nombres_alternativos": spellings, **{c: F.coalesce(c, f"_{c}") for c in own}}).select(people.columns)


def reassigned(docs: DataFrame, merges: DataFrame) -> DataFrame:
    """Documents whose authors and contributors point to the people that are left, in their order and without repeats."""
    mapping = remap(merges)
    flat = docs.select("_id", F.posexplode(F.coalesce("autores", F.array().cast("array<string>"))).alias("at", "_p"), F.lit(None).cast("string").alias("_role"))
    flat = flat.unionByName(docs.select("_id", F.posexplode("contribuciones").alias("at", "_c")).select("_id", "at", F.col("_c.persona").alias("_p"), F.coalesce("_c.rol", F.lit("")).alias("_role")))
    flat = _moved(flat, "_p", mapping)
    got = flat.groupBy("_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_role").isNull(), F.struct("at", "_p")))).alias("_a"), F.array_sort(F.collect_list(F.when(F.col("_role").isNotNull(), F.struct("at", F.col("_p").alias("persona"), F.col("_role").alias("rol"))))).alias("_c"),
    )
    rows = docs.join(got, "_id", "left")
    people = F.array_distinct(F.col("_a._p"))
    roles = F.array_distinct(F.transform("_c", lambda x: F.struct(x["persona"].alias("persona"), F.when(x["rol"] != "", x["rol"]).alias("rol"))))
    return rows.withColumns({"autores": F.when(F.col("autores").isNotNull(), people), "contribuciones": F.when(F.col("contribuciones").isNotNull(), roles)}).select(docs.columns)


def _freed(docs: DataFrame, kind: str, leaves: Column) -> DataFrame:
    return docs.withColumns({c: F.when(leaves, F.lit(None)).otherwise(F.col(c)) for c in BELONGING[kind] if c in docs.columns})


def exploded(docs: DataFrame, groups: DataFrame, kind: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the groups ``ids`` stand alone; the groups are gone."""
    gone = ids.select(F.col("_id").alias(kind)).distinct().withColumn("_gone", F.lit(True))
    rows = docs.join(gone, kind, "left")
    return _freed(rows, kind, F.coalesce("_gone", F.lit(False))).select(docs.columns), groups.join(ids.select("_id"), "_id", "left_anti")


def expelled(docs: DataFrame, groups: DataFrame, kind: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents ``ids`` leave their group; groups that lose their last member by that are dropped, other empty ones stay."""
    rows = docs.join(ids.select("_id").distinct().withColumn("_out", F.lit(True)), "_id", "left")
    out = F.coalesce("_out", F.lit(False))
    left = rows.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count_if(out).alias("_lost"), F.count_if(~out).alias("_stay")).where("_lost > 0 and _stay = 0")
    return _freed(rows, kind, out).select(docs.columns), groups.join(left.select(F.col(kind).alias("_id")), "_id", "left_anti")


def without_empty(groups: DataFrame, docs: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """Groups without those of ``ids`` that no document refers to; the others of ``ids`` stay."""
    empty = ids.select("_id").join(docs.select(F.col(kind).alias("_id")), "_id", "left_anti")
    return groups.join(empty, "_id", "left_anti")


# --- changes that can be taken back


def recorded(before: DataFrame, after: DataFrame, columns: list[str], at: Column, key: str = "_id") -> DataFrame:
    """``key, column, old, at``: the values that a change replaced, as text; one row a changed value."""
    rows = before.select(key, *columns).join(after.select(key, *(F.col(c).alias(f"_{c}") for c in columns)), key)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(c).alias("v"))).alias("old"), F.to_json(F.struct(F.col(f"_{c}").alias("v"))).alias("new")) for c in columns))
    return rows.select(key, F.explode(each).alias("x")).where(~F.col("x.old").eqNullSafe(F.col("x.new"))).select(key, "x.column", "x.old", at.alias("at"))


def undone(now: DataFrame, changes: DataFrame, since: str, until: str, expected: int, key: str = "_id") -> DataFrame:
    """``now`` as it was before the changes with ``since`` <= at < ``until``; of several changes of a value the first one's old value counts.

    Raises unless exactly ``expected`` rows would change, so that a wrong window does nothing.
    """
    own = changes.where((F.col("at") >= F.to_timestamp(F.lit(since))) & (F.col("at") < F.to_timestamp(F.lit(until))))
    first = own.groupBy(key, "column").agg(F.min_by("old", "at").alias("old"))
    found = first.select(key).distinct().join(now.select(key), key, "left_semi").count()
    if found != expected:
        raise ValueError(f"{found} rows would change, {expected} were expected")
    columns = [c for c in now.columns if c != key]
    wide = first.groupBy(key).agg(*(F.max(F.when(F.col("column") == c, F.col("old"))).alias(f"_{c}") for c in columns))
    rows = now.join(wide, key, "left")
    kinds = {f.name: f.dataType for f in now.schema.fields}
    old = {c: F.from_json(f"_{c}", f"v {kinds[c].simpleString()}")["v"] for c in columns}
    return rows.withColumns({c: F.when(F.col(f"_{c}").isNotNull(), old[c]).otherwise(F.col(c)) for c in columns}).select(now.columns)


def dangling(docs: DataFrame, people: DataFrame) -> DataFrame:
    """``persona, rol, nombre, docs``: references to people that are not there; a name only if one is known for that role in all those documents.

    ``contribuciones`` may hold a ``nombre`` as it was written.
    """
    refs = docs.select("_id", F.explode("contribuciones").alias("c")).select("_id", "c.persona", "c.rol", "c.nombre").where("persona is not null")
    lost = refs.join(people.select(F.col("_id").alias("persona")), "persona", "left_anti")
    got = lost.groupBy("persona", "rol").agg(F.count_distinct("nombre").alias("n"), F.min("nombre").alias("nombre"), F.count_distinct("_id").alias("docs"))
    return got.select("persona", "rol", F.when(F.col("n") == 1, F.col("nombre")).alias("nombre"), "docs")
