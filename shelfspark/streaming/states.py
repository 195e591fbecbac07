"""Keyed state with timers and an end: throttling, stable files and folders, classes that stick.

All run on ``transformWithState``, so they need the RocksDB state store (:func:`with_state_store`).  Every state has a time to
live, counted in processing time from its last change, and those that decide something end it themselves, so the store holds
what is going on and not all that ever was.  Since times to live run on, such a stream never comes to an end by itself, not even with an
``availableNow`` trigger: stop it.  Each has a twin on a whole table in the tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from shelfspark.shipping import shipped

DAY_MS = 86_400_000


def with_state_store(spark: SparkSession) -> None:
    """Use the state store that these streams need for the queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Walk(StatefulProcessor):
    """Walks each key's rows in order with one value of state; ``step(state, row)`` gives the new state (None: the end) and what to put out."""

    def __init__(self, state: str, order: list[str], columns: list[str], step: Callable, ttl_ms: int) -> None:
        self.schema, self.order, self.columns, self.step, self.ttl_ms = state, order, columns, step, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", self.schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = self.state.get() if self.state.exists() else None, []
        for row in pd.concat(list(rows)).sort_values(self.order).itertuples(index=False):
            now, put = self.step(now, row)
            if put is not None:
                out.append((*key, *put))
        if now is None:
            self.state.clear()
        else:
            self.state.update(now)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def walked(rows: DataFrame, key: str, made: str, walk: Walk) -> DataFrame:
    shipped(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=walk, outputStructType=made, outputMode="Append", timeMode="ProcessingTime")


def throttled(events: DataFrame, key: str, window_ms: int, at: str = "t_ms", id_col: str = "event_id", ttl_ms: int = DAY_MS) -> DataFrame:
    """``key, id`` of events (time in milliseconds) that come ``window_ms`` or more after the last one let through.

    ``ttl_ms`` is how much later than another an event may arrive and still be held back by it.
    """

    def step(last, row):
        t = int(getattr(row, at))
        return (last, None) if last is not None and t - last[0] < window_ms else ((t,), (int(getattr(row, id_col)),))

    return walked(events.select(key, at, id_col), key, f"{key} long, {id_col} long", Walk("last long", [at, id_col], [key, id_col], step, ttl_ms))


def stable_files(looks: DataFrame, wait_ms: int = 1500, phantom_ms: int = 600_000, ttl_ms: int = DAY_MS) -> DataFrame:
    """``ruta, estado`` once a file's size (``ruta, t_ms, bytes``) is the same ``wait_ms`` later, or it has been empty for ``phantom_ms``.

    What was told of a file isn't told again before its size changes.
    """

    def step(now, row):
        t, n = int(row.t_ms), int(row.bytes)
        if now is None or now[1] != n:
            return (t, n, False), None
        first, _, told = now
        if told or t - first < (phantom_ms if n == 0 else wait_ms):
            return now, None
        return (first, n, True), ("fantasma" if n == 0 else "estable",)

    return walked(looks.select("ruta", "t_ms", "bytes"), "ruta", "ruta string, estado string", Walk("first long, bytes long, told boolean", ["t_ms"], ["ruta", "estado"], step, ttl_ms))


def stable_folders(looks: DataFrame, wait_ms: int = 45_000, ttl_ms: int = DAY_MS) -> DataFrame:
    """``carpeta, t_ms`` of the looks (``carpeta, t_ms, ficheros, bytes, nuevo_ms``) at which a folder turns out to be wholly there.

    It is if its newest file is ``wait_ms`` old, or if count and bytes have not changed for that long; an empty folder never is, and it is
    told once for each content.  A look without files ends the state.
    """

    def step(now, row):
        t, n, size = int(row.t_ms), int(row.ficheros), int(row.bytes)
        if n == 0:
            return None, None
        since, told = (t, False) if now is None or (now[1], now[2]) != (n, size) else (now[0], now[3])
        settled = t - int(row.nuevo_ms) >= wait_ms or t - since >= wait_ms
        return (since, n, size, told or settled), ((t,) if settled and not told else None)

    return walked(looks.select("carpeta", "t_ms", "ficheros", "bytes", "nuevo_ms"), "carpeta", "carpeta string, t_ms long", Walk("since long, n long, size long, told boolean", ["t_ms"], ["carpeta", "t_ms"], step, ttl_ms))


#: Classes of a folder, the first that was ever seen of the earliest in this order stays.
STICKY = ("transmedia", "coleccion_audio", "audiolibro", "normal")


def sticky_classes(looks: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """``carpeta, t_ms, clase``: the class of a folder at each look (``carpeta, t_ms, clase``), which never falls back to a weaker one.

    A look without a class says that the folder is gone, and ends its state.
    """

    def step(now, row):
        if row.clase is None or row.clase != row.clase:
            return None, None
        best = min(STICKY.index(row.clase), now[0] if now is not None else len(STICKY))
        return (best,), (int(row.t_ms), STICKY[best])

    return walked(looks.select("carpeta", "t_ms", "clase"), "carpeta", "carpeta string, t_ms long, clase string", Walk("best int", ["t_ms"], ["carpeta", "t_ms", "clase"], step, ttl_ms))
