"""Streaming forms of the store's history, cache and watch state. Extensions: the reference application keeps these in a database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history(stream: DataFrame, ts: str, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """Events once each, late ones within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def activity(stream: DataFrame, ts: str, window: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Events of each kind by tumbling window of event time; no delay for a stream that has a watermark already."""
    marked = stream if delay is None else stream.withWatermark(ts, delay)
    return marked.groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def resume_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends only rows whose keys aren't stored yet; a batch that is replayed adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:  # the first batch: nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return write


def watch_state(stream: DataFrame, key: list[str], ts: str) -> DataFrame:
    """(key, watched, watched_at) as toggles arrive; for complete or update mode."""
    n = stream.groupBy(*key).agg(F.count("*").alias("toggles"), F.max(ts).alias("last"))
    return n.select(*key, (F.col("toggles") % 2 == 1).alias("watched"), F.when(F.col("toggles") % 2 == 1, F.col("last")).alias("watched_at"))
