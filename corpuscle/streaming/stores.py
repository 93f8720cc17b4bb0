"""Stores kept by a stream: entities with their mentions, and cached answers that expire."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import latest

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a store hands on at once.
ROWS = 50_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which typed state and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def entity_updates(mentions: DataFrame) -> DataFrame:
    """A stream of (type, name, mentions, first_seen, last_seen, context), a row for each entity that a batch mentions.

    ``mentions`` streams (type, name, event_id, seen_at, mentions, context). Counts add up; the context is that of the
    latest mention, by seen_at and then event_id, whatever the order in which batches arrive. The sums are aggregates, so
    no row goes through Python; inside ``keyed_state`` they lie on disk.
    """
    return entities_of(mentions)


def entities_of(mentions: DataFrame) -> DataFrame:
    """The same from a table, in one go, or in update mode from a stream."""
    shaped = mentions.where("type is not null and name is not null and seen_at is not null")
    return shaped.groupBy("type", "name").agg(
        F.sum("mentions").alias("mentions"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.max_by("context", F.struct("seen_at", "event_id")).alias("context")
    )


class AnswerCache(StatefulProcessor):
    """One key's cached answer: put with a time to live, asked for, and dropped by a timer when its time is over."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "put_ms long, answer string, hits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entry = self.entry.get() if self.entry.exists() else None
        # Columns of all rows, but answers of puts only: a key may have any share of a batch.
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for part in rows:
            put = (part["kind"] == "put").to_numpy(bool)
            times = part["at"].to_numpy("datetime64[ns]").view(np.int64)
            for held, found in zip(columns, (times, part["event_id"].to_numpy(np.int64), put, part["answer"].to_numpy(object)[put])):
                held.append(found)
        at, ids, put, answers = (np.concatenate(c) for c in columns)
        answer_no = np.cumsum(put) - 1
        order = np.lexsort((ids, at))
        ms, ids, put, answer_no = at[order] // 1_000_000, ids[order], put[order], answer_no[order]
        last = np.maximum.accumulate(np.where(put, np.arange(len(put)), -1))  # -1: the entry of an earlier batch
        known = (last >= 0) | (entry is not None)
        since, old, hits_before = entry if entry is not None else (0, None, 0)
        age = ms - np.where(last >= 0, ms[last], since)
        hit = known & ~put & (age >= 0) & (age < self.ttl_ms)
        count = np.cumsum(hit)
        hits = np.where(hit, count - np.where(last >= 0, count[last], -hits_before), 0)
        if last[-1] >= 0:
            end = last[-1]
            entry = (int(ms[end]), answers[answer_no[end]], int(count[-1] - count[end]))
            self.handle.registerTimer(entry[0] + self.ttl_ms)  # earlier puts are replaced already
        elif entry is not None:
            entry = (entry[0], entry[1], hits_before + int(count[-1]))
        if entry is not None:
            self.entry.update(entry)
        asked = np.nonzero(~put)[0]
        for first in range(0, max(1, len(asked)), ROWS):
            g = asked[first : first + ROWS]
            told = [(answers[answer_no[last[i]]] if last[i] >= 0 else old) if hit[i] else None for i in g.tolist()]
            yield pd.DataFrame({"key": np.full(len(g), key[0], object), "event_id": ids[g], "hit": hit[g], "answer": np.array(told, object), "hits": hits[g]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[0] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame([], columns=["key", "event_id", "hit", "answer", "hits"])

    def close(self) -> None:
        pass


def cache_answers(events: DataFrame, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, event_id, hit, answer, hits), a row for each event that asks.

    ``events`` streams (key, event_id, kind, at, answer), kind ``put`` or ``get``. A get hits if the last put of its
    key is less than ``ttl_seconds`` old; ``hits`` counts those since that put. Events are taken in order of time
    within a batch and batches as they come; those older than the watermark (``late``) are dropped. An entry goes when the watermark passes its end. Start it inside ``keyed_state``.
    """
    timed = events.where("key is not null and at is not null").withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(AnswerCache(ttl_seconds), "key string, event_id long, hit boolean, answer string, hits long", "Append", "EventTime")


def answers_of(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """The same from a table, in one go."""
    from pyspark.sql import Window

    before = Window.partitionBy("key").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = events.where("key is not null and at is not null")
    puts = timed.withColumn("put", F.last(F.when(F.col("kind") == "put", F.struct("at", "answer", "event_id")), True).over(before)).where("kind <> 'put'")
    fresh = F.coalesce(F.unix_micros("at") - F.unix_micros("put.at") < ttl_seconds * 1_000_000, F.lit(False))
    run = Window.partitionBy("key", "put.event_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    judged = puts.withColumn("hit", fresh)
    return judged.select("key", "event_id", "hit", F.when(F.col("hit"), F.col("put.answer")).alias("answer"), F.when(F.col("hit"), F.count_if("hit").over(run)).otherwise(0).alias("hits"))


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Takes what is there, writes each batch under its number and ends; the progress of its batches."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/part={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def last_of_each(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last row that the batches of a store wrote for each key."""
    return latest(written, keys, ["batch_no"]).drop("batch_no", "part")
