"""Sessions and interval joins of streams, with watermarks that close them and counts of what came too late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_totals(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", at: str = "ts", value: str = "value") -> DataFrame:
    """(user, started, ended, events, total) of each user's sessions: events less than ``gap`` apart.

    In a stream a session is given once, when the watermark (``late`` behind the latest event) has passed its end;
    events older than the watermark are dropped. From a table every session is given. ``ended`` is the last event plus the gap; null times
    are in no session.
    """
    timed = events.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    sums = timed.groupBy(F.session_window(at, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return sums.select(user, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events", "total")


def during_locks(locks: DataFrame, events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """(page_id, lock_id, event_id): events (page_id, event_id, at) of a page while a lock (page_id, lock_id, acquired) was held.

    A lock is held for ``seconds`` from ``acquired`` on. Both sides may be streams: the interval and the watermarks tell how
    long a lock or an event has to be remembered, and what is older is forgotten. Rows with a null page or time meet nothing.
    """
    held = locks.select(F.col("page_id").alias("locked"), "lock_id", F.col("acquired").cast("timestamp").alias("acquired")).withWatermark("acquired", late)
    seen = events.select("page_id", "event_id", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    within = F.expr(f"page_id = locked AND at >= acquired AND at < acquired + INTERVAL {seconds} SECONDS")
    return held.join(seen, within).select("page_id", "lock_id", "event_id")


def dropped_late(progress: list) -> int:
    """How many rows the batches of a query dropped as they were older than the watermark."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in progress for s in p["stateOperators"])
