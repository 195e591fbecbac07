"""The activity log: throttling of a table, sessions, retention; throttling of a stream is in ``states``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throttled(events: DataFrame, key: str, window_ms: int, at: str = "ts", id_col: str = "event_id") -> DataFrame:
    """``key, id`` of events at least ``window_ms`` after the last one of their key that was let through.

    A comparison with the event just before would let other ones through, so each key's events are walked in order.
    They stream past sorted, a batch at a time, and the walk jumps from one event let through to the next.
    Events without a key or a time are left out.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, 0
        for rows in batches:
            keys, times = rows[key].to_numpy(), rows["t"].to_numpy()
            kept: list[int] = []
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                i = a if keys[a] != last_key else a + int(np.searchsorted(times[a:b], last + window_ms))
                while i < b:
                    kept.append(i)
                    last = int(times[i])
                    i = a + int(np.searchsorted(times[a:b], last + window_ms))
                last_key = keys[a]
            yield rows.iloc[kept][[key, id_col]]

    rows = events.select(F.col(key).cast("long").alias(key), F.unix_millis(F.col(at).cast("timestamp")).alias("t"), F.col(id_col).cast("long").alias(id_col))
    rows = rows.where(F.col(key).isNotNull() & F.col("t").isNotNull()).repartition(key).sortWithinPartitions(key, "t", id_col)
    return rows.mapInPandas(walk, f"{key} long, {id_col} long")


def debounced(events: DataFrame, key: str, gap: str = "2500 milliseconds", at: str = "ts") -> DataFrame:
    """Bursts of events with less than ``gap`` between neighbours: ``start, end, n``."""
    s = F.session_window(at, gap)
    return events.groupBy(key, s.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_day(events: DataFrame, at: str = "ts", late: str | None = None) -> DataFrame:
    """Events a day; over a stream, days close when ``late`` has passed."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def retained(events: DataFrame, now, days: int = 365, at: str = "ts") -> DataFrame:
    return events.where(F.col(at) >= F.lit(now) - F.expr(f"interval {days} days"))


def client_ip(c):
    """The first forwarded address, without an IPv4-in-IPv6 prefix."""
    return F.regexp_replace(F.trim(F.substring_index(c, ",", 1)), "^::ffff:", "")
