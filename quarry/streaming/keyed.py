"""Keyed state in streams: a result cache whose entries expire, and libraries that take puts, toggles, deletions and clearing. Extensions, as state.py.

Both keep one state for each key in the state store (RocksDB, so it may outgrow memory) and write rows as things change; a batch that is run again after a failure starts from the state before it. Rows of a batch are applied in order of time; what is older than the state it would change is late and ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Cache(StatefulProcessor):
    def __init__(self, keys: int, seconds: int) -> None:
        self.keys, self.seconds = keys, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_ms", "value_"])
        at, value = int(batch["at_ms"].iloc[-1]), batch["value_"].iloc[-1]
        if self.entry.exists():
            old = self.entry.get()
            if (old[0], old[1]) >= (at, value):
                return
            self.handle.deleteTimer(old[0] + 1000 * self.seconds)
        self.entry.update((at, value))
        self.handle.registerTimer(at + 1000 * self.seconds)
        yield self.row(key, at, value, "put")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            at, value = self.entry.get()
            if at + 1000 * self.seconds <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield self.row(key, at, value, "expired")

    def row(self, key, at, value, what) -> pd.DataFrame:
        return pd.DataFrame({**{f"k{i}": [k] for i, k in enumerate(key)}, "at": [at], "value": [value], "what": [what]})

    def close(self) -> None:
        pass


def _typed(out: DataFrame, stream: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[c for c in out.columns if c not in {f"k{i}" for i in range(len(keys))}])


def cache(stream: DataFrame, keys: list[str], ts: str, value: str, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(keys, created_at, value, what): `put` when a key's entry is written or replaced by a newer one, `expired` once the watermark has passed its time to live. Events older than the watermark are dropped, older than the entry ignored."""
    kinds = ", ".join(f"k{i} {stream.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    named = stream.withWatermark(ts, delay).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), F.col(value).cast("string").alias("value_"))
    out = named.groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithStateInPandas(_Cache(len(keys), seconds), StructType.fromDDL(f"{kinds}, at long, value string, what string"), "append", "eventTime")
    return _typed(out.withColumn("created_at", F.timestamp_millis("at")).drop("at"), stream, keys)


class _Library(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "watched boolean, at long, live boolean")
        self.cleared = handle.getValueState("cleared", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        floor = self.cleared.get()[0] if self.cleared.exists() else -1

        def put(item: str, watched: bool, at: int, live: bool) -> None:
            self.items.updateValue((item,), (watched, at, live))  # a deleted item stays as a mark: events from before its deletion are late
            changed[item] = (watched, at, live)

        for r in pd.concat(list(rows)).sort_values(["at_ms", "order_"]).itertuples():
            at, kind, item = int(r[-4]), r[-3], r[-2]
            if at < floor:
                continue
            if kind == "clear":
                for k in [k[0] for k in self.items.keys()]:
                    if self.items.getValue((k,))[2]:
                        put(k, False, at, False)
                floor = at
                self.cleared.update((at,))
                continue
            if item is None:
                continue
            watched, last, live = self.items.getValue((item,)) if self.items.containsKey((item,)) else (False, -1, False)
            if at < last:
                continue
            if kind == "delete" and live:
                put(item, False, at, False)
            elif kind == "put" and not live:
                put(item, False, at, True)
            elif kind == "toggle" and live:
                put(item, not watched, at, True)
        if changed:
            names = sorted(changed)
            yield pd.DataFrame({"k0": [key[0]] * len(names), "item": names, "watched": [changed[n][0] for n in names], "at": [changed[n][1] for n in names], "live": [changed[n][2] for n in names]})

    def close(self) -> None:
        pass


def library(stream: DataFrame, user: str, item: str, kind: str, ts: str, order: str) -> DataFrame:
    """(user, item, live, watched, changed_at) of the items that a batch changed, as they are after it. kind: `put` (adds an item that isn't there), `toggle` (of one that is), `delete`, `clear` (all of the user's items). order: among events of the same time."""
    named = stream.select(F.col(user).alias("k0"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), F.col(kind).alias("kind_"), F.col(item).cast("string").alias("item_"), F.col(order).cast("long").alias("order_"))
    schema = StructType.fromDDL(f"k0 {stream.schema[user].dataType.simpleString()}, item string, watched boolean, at long, live boolean")
    out = named.groupBy("k0").transformWithStateInPandas(_Library(), schema, "append", "none")
    return out.select(F.col("k0").alias(user), F.col("item").alias(item), "live", "watched", F.timestamp_millis("at").alias("changed_at"))
