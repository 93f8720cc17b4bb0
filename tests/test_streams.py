"""Streams against the same rows as a table: stores, expiry, sessions, late rows, interval joins, also after a restart."""

import datetime as dt
import random
import tempfile

import pandas as pd

from corpuscle.streaming import stores, windows

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def folder():
    return tempfile.mkdtemp(prefix="corpuscle-stream-")


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


MENTION = "type string, name string, event_id long, seen_at timestamp, mentions long, context string"


def test_entity_store_equals_table_also_after_restart(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["tech", "person"]), rng.choice("abcde"), i, at(rng.randint(0, 50)), rng.randint(1, 3), f"c{i}" if i % 7 else None) for i in range(200)] + [(None, "x", 900, at(1), 1, "n"), ("tech", "x", 901, None, 1, "n")]
    source, target, checkpoint = folder(), folder(), folder()
    with stores.keyed_state(spark):
        for part in (rows[:90], rows[90:150], rows[150:]):  # each a run of its own over the same checkpoint
            put(spark, part, MENTION, source)
            stores.run_available(stores.entity_updates(spark.readStream.schema(MENTION).parquet(source)), target, checkpoint, "update")
    written = spark.read.parquet(target)
    assert written.select("part").distinct().count() == 3
    columns = ["type", "name", "mentions", "first_seen", "last_seen", "context"]
    got = stores.last_of_each(written, ["type", "name"]).select(*columns)
    assert rows_of(got) == rows_of(stores.entities_of(spark.createDataFrame(rows, MENTION)).select(*columns))


EVENT = "key string, event_id long, kind string, at timestamp, answer string"


def test_cache_hits_and_expiry_equal_table_also_after_restart(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i, "put" if rng.random() < 0.25 else "get", at(i * 3), f"answer {i}") for i in range(120)]
    rows = [(k, i, kind, t, a if kind == "put" else None) for k, i, kind, t, a in rows]
    source, target, checkpoint = folder(), folder(), folder()
    with stores.keyed_state(spark):
        for part in (rows[:40], rows[40:80], rows[80:]):
            put(spark, part, EVENT, source)
            progress = stores.run_available(stores.cache_answers(spark.readStream.schema(EVENT).parquet(source), 1800), target, checkpoint)
    columns = ["key", "event_id", "hit", "answer", "hits"]
    got = spark.read.parquet(target).select(*columns)
    want = stores.answers_of(spark.createDataFrame(rows, EVENT), 1800).select(*columns)
    assert rows_of(got) == rows_of(want)
    assert 0 < want.where("hit").count() < want.count()
    assert progress


def test_entities_are_summed_outside_python(spark):
    stream = stores.entity_updates(spark.readStream.schema(MENTION).parquet(folder()))
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "InPandas" not in stream._jdf.queryExecution().analyzed().toString()


def test_cache_takes_a_batch_with_one_timer():
    """However many puts a batch has, the last alone gets a timer; pieces of a batch may come in any order."""
    timers, kept = [], []

    class Handle:
        def getValueState(self, *_):
            return self

        def exists(self):
            return bool(kept)

        def get(self):
            return kept[-1]

        def update(self, value):
            kept.append(value)

        def registerTimer(self, ms):
            timers.append(ms)

    cache = stores.AnswerCache(60)
    cache.init(Handle())
    rows = pd.DataFrame([(i, "put" if i % 3 == 0 else "get", pd.Timestamp(at(0)) + pd.Timedelta(seconds=i), f"a{i}" if i % 3 == 0 else None) for i in range(3000)], columns=["event_id", "kind", "at", "answer"])
    out = pd.concat(cache.handleInputRows(("k",), iter([rows[1500:], rows[:1500]]), None))
    assert len(out) == 2000 and out["hit"].all() and len(timers) == 1
    assert all(a == f"a{e - e % 3}" and h == e % 3 for e, a, h in zip(out["event_id"], out["answer"], out["hits"]))
    more = pd.DataFrame([(4000, "get", pd.Timestamp(at(0)) + pd.Timedelta(seconds=3001), None), (4001, "get", pd.Timestamp(at(9000)), None)], columns=["event_id", "kind", "at", "answer"])
    out = pd.concat(cache.handleInputRows(("k",), iter([more]), None))
    assert [tuple(r) for r in out[["event_id", "hit", "answer", "hits"]].astype(object).itertuples(index=False)] == [(4000, True, "a2997", 3), (4001, False, None, 0)]


def test_batches_have_several_files(spark):
    from corpuscle.plans import stream_queries

    base = folder()
    stream_queries._streamed(spark, spark.range(1000), 2, base)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet(f"{base}/in").selectExpr("input_file_name() AS f").distinct().count() == 2 * tasks > 2


SEEN = "user_id long, ts timestamp, value double"


def test_sessions_close_and_late_rows_are_counted(spark):
    source, target, checkpoint = folder(), folder(), folder()
    stream = windows.session_totals(spark.readStream.schema(SEEN).parquet(source), "10 minutes", "20 minutes")
    first = [(1, at(0), 1.0), (1, at(5), 2.0), (1, at(30), 4.0), (2, at(3), 8.0), (3, None, 1.0)]
    put(spark, first, SEEN, source)
    stores.run_available(stream, target, checkpoint)
    put(spark, [(1, at(100), 16.0)], SEEN, source)  # the watermark goes to minute 80
    stores.run_available(stream, target, checkpoint)
    put(spark, [(2, at(7), 32.0), (2, at(79), 64.0), (1, at(95), 128.0), (4, at(200), 1.0)], SEEN, source)  # the first is late
    progress = stores.run_available(stream, target, checkpoint)
    put(spark, [(4, at(300), 1.0)], SEEN, source)
    progress += stores.run_available(stream, target, checkpoint)
    got = spark.read.parquet(target).select("user_id", "started", "events", "total")
    kept = first + [(1, at(100), 16.0), (2, at(79), 64.0), (1, at(95), 128.0), (4, at(200), 1.0)]
    want = windows.session_totals(spark.createDataFrame(kept, SEEN), "10 minutes", "20 minutes").select("user_id", "started", "events", "total")
    assert rows_of(got) == rows_of(want)
    assert windows.dropped_late(progress) == 1


def test_events_under_lock_meet_in_a_stream(spark):
    locks = [(1, i, at(10 * i)) for i in range(6)] + [(2, 50, at(0)), (None, 51, at(0))]
    events = [(1, 100 + i, at(7 * i)) for i in range(9)] + [(2, 200, at(1)), (2, 201, at(2)), (3, 202, at(0)), (None, 203, at(0))]
    lock_schema, event_schema = "page_id long, lock_id long, acquired timestamp", "page_id long, event_id long, at timestamp"
    left, right, target, checkpoint = folder(), folder(), folder(), folder()
    stream = windows.during_locks(spark.readStream.schema(lock_schema).parquet(left), spark.readStream.schema(event_schema).parquet(right), 120)
    for a, b in ((locks[:3], events[:5]), (locks[3:], events[5:])):
        put(spark, a, lock_schema, left)
        put(spark, b, event_schema, right)
        stores.run_available(stream, target, checkpoint)
    want = windows.during_locks(spark.createDataFrame(locks, lock_schema), spark.createDataFrame(events, event_schema), 120)
    got = spark.read.parquet(target).select("page_id", "lock_id", "event_id")
    assert rows_of(got) == rows_of(want) and want.count() >= 2
