"""Integrity diagnosis and sealed, versioned upkeep tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.model import absent


@dataclass(frozen=True)
class Task:
    """A transform with a version; it runs where it applies and was not yet sealed with this version."""

    name: str
    version: int
    applies: Callable[[], Column]
    values: Callable[[], dict[str, Column]]


def unsealed(task: Task, seals: str = "mantenimiento") -> Column:
    return ~F.element_at(F.col(seals), task.name).eqNullSafe(task.version)


def run_task(docs: DataFrame, task: Task, seals: str = "mantenimiento") -> DataFrame:
    """Documents after the task; whatever it was due on is sealed, changed or not."""
    due, hit = unsealed(task, seals), unsealed(task, seals) & F.coalesce(task.applies(), F.lit(False))
    sealed = F.map_concat(F.map_filter(F.coalesce(seals, F.create_map().cast("map<string,int>")), lambda k, _: k != task.name), F.create_map(F.lit(task.name), F.lit(task.version)))
    changed = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in task.values().items()}
    return docs.withColumns(changed | {seals: F.when(due, sealed).otherwise(F.col(seals))})


def run_campaign(docs: DataFrame, task: Task, batch: int, seals: str = "campanas") -> DataFrame:
    """One batch: the first ``batch`` candidates by id are treated and sealed, the rest wait."""
    candidates = docs.where(unsealed(task, seals) & F.coalesce(task.applies(), F.lit(False))).select("_id").orderBy("_id").limit(batch)
    own = docs.join(candidates, "_id", "left_semi")
    return run_task(own, task, seals).unionByName(docs.join(candidates, "_id", "left_anti"))


def health(docs: DataFrame, tasks: list[Task], seals: str = "mantenimiento") -> DataFrame:
    """``_id, task, state``: done, due or not applicable, for every document and task."""
    states = F.array(*(F.struct(F.lit(t.name).alias("task"), F.when(~unsealed(t, seals), "hecha").when(F.coalesce(t.applies(), F.lit(False)), "pendiente").otherwise("no_aplica").alias("state")) for t in tasks))
    return docs.select("_id", F.explode(states).alias("x")).select("_id", "x.*")


def diagnose(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``_id, defect``: no folder, no cover, no original, shared folder, hash shared with another document."""
    folders = files.select(F.col("carpeta").alias("ruta_base"), F.lit(True).alias("_there")).distinct()
    originals = files.where("formato not in ('imagen', 'desconocido', 'otro')").select(F.col("carpeta").alias("ruta_base"), F.lit(True).alias("_original")).distinct()
    shared = docs.groupBy("ruta_base").agg(F.count("*").alias("_sharers"))
    same = docs.where("hash_contenido is not null and not coalesce(ruta_fija, false)").groupBy("hash_contenido").agg(F.count("*").alias("_copies"))
    rows = docs.join(folders, "ruta_base", "left").join(originals, "ruta_base", "left").join(shared, "ruta_base", "left").join(same, "hash_contenido", "left")
    found = F.array_compact(F.array(
        F.when(F.col("_there").isNull(), "sin_carpeta"), F.when(absent(F.col("portada")), "sin_portada"), F.when(F.col("_there").isNotNull() & F.col("_original").isNull(), "sin_original"),
        F.when(F.col("_sharers") > 1, "carpeta_compartida"), F.when(F.col("_copies") > 1, "hash_repetido"),
    ))
    return rows.select("_id", F.explode(found).alias("defect"))


def reconcile(catalogued: DataFrame, on_disk: DataFrame) -> DataFrame:
    """``ruta, estado``: owned (both sides), lost (catalogue only), orphan (disk only)."""
    rows = catalogued.select("ruta", F.lit(True).alias("_c")).distinct().join(on_disk.select("ruta", F.lit(True).alias("_d")).distinct(), "ruta", "full")
    return rows.select("ruta", F.when(F.col("_c") & F.col("_d"), "propia").when(F.col("_c"), "perdida").otherwise("huerfana").alias("estado"))
