"""Keyed streams: expiry, late events, batches that run again, and the batch forms of the same."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.session import checkpoint_root
from quarry.streaming import keyed

DAY = dt.datetime(2024, 5, 6)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


@pytest.fixture
def folder(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_state_store(spark)
    yield f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def run(spark, folder, schema, make, rows):
    """Adds a file of events and lets the stream take what is new; what it has written so far."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    return spark.read.parquet(f"{folder}/out")


def test_cache_entries_expire_once(spark, folder):
    schema = "mode string, asked string, at timestamp"
    make = lambda s: keyed.cache(s, ["mode"], "at", "asked", 3600, "10 minutes")
    seen = lambda out: sorted((r["mode"], r["value"], r["what"], r["created_at"]) for r in out.collect())
    first = run(spark, folder, schema, make, [("a", "x", at(0)), ("a", "y", at(5)), ("b", "z", at(1))])
    assert seen(first) == [("a", "y", "put", at(5)), ("b", "z", "put", at(1))]
    # older than the entry, but not than the watermark: ignored; a newer one replaces it and its expiry
    second = run(spark, folder, schema, make, [("a", "old", at(3)), ("b", "w", at(40))])
    assert seen(second)[1:] == [("b", "w", "put", at(40)), ("b", "z", "put", at(1))]
    # an hour later than a's entry by the watermark; the event from before it is late and dropped
    third = run(spark, folder, schema, make, [("c", "n", at(80)), ("d", "late", at(-500))])
    third = run(spark, folder, schema, make, [("c", "m", at(81))])
    what = {(r[0], r[2]) for r in seen(third)}
    assert ("a", "expired") in what and ("b", "expired") not in what and not any(r[0] == "d" for r in seen(third))
    again = run(spark, folder, schema, make, [("c", "k", at(20))])  # older than c's entry
    assert seen(again) == seen(third)


def plain(events):
    """user -> item -> watched, event by event."""
    out = {}
    for user, item, kind, _, _ in sorted(events, key=lambda e: (e[3], e[4])):
        mine = out.setdefault(user, {})
        if kind == "clear":
            mine.clear()
        elif kind == "delete":
            mine.pop(item, None)
        elif kind == "put":
            mine.setdefault(item, False)
        elif kind == "toggle" and item in mine:
            mine[item] = not mine[item]
    return {(u, i): w for u, items in out.items() for i, w in items.items()}


def test_library_equals_event_by_event(spark, folder):
    schema = "user int, film string, kind string, at timestamp, n long"
    make = lambda s: keyed.library(s, "user", "film", "kind", "at", "n")
    first = [(1, "x", "put", at(0), 1), (1, "x", "toggle", at(1), 2), (1, "y", "put", at(2), 3), (2, "x", "toggle", at(2), 4), (2, "z", "put", at(3), 5), (2, "z", "put", at(4), 6)]
    second = [(1, "x", "toggle", at(5), 7), (1, "x", "toggle", at(5), 8), (1, "y", "delete", at(6), 9), (2, None, "clear", at(7), 10), (2, "q", "put", at(8), 11), (2, "q", "toggle", at(9), 12)]
    late = [(1, "y", "put", at(3), 13), (2, "z", "put", at(4), 14), (1, "x", "delete", at(2), 15)]
    back = [(1, "y", "put", at(20), 16)]
    events = []
    for rows in (first, second, late, back):
        events += rows
        out = run(spark, folder, schema, make, rows)
        last = out.groupBy("user", "film").agg(F.max_by(F.struct("live", "watched"), "changed_at").alias("v"))
        got = {(r["user"], r["film"]): r["v"]["watched"] for r in last.collect() if r["v"]["live"]}
        assert got == plain([e for e in events if e not in late])
