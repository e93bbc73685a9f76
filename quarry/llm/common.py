"""Shared parts of the operators: column selection, bounded samples, Arrow plumbing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.session import stored


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, mod n (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(ids: list, n: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % n for x in ids], dtype=np.int64)


def trim() -> None:
    """Gives a worker's free memory back to the system: workers live on from task to task beside the JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(spark: SparkSession) -> None:
    """Lets the driver give back what it has done with: Python's free memory, the JVM's plans of queries that are over, and the files of their shuffles, which Spark drops once its garbage has been collected. Events that listeners haven't had yet hold on to queries that are over, so those are waited for; and each listener's thread holds on to the last event that it had, a query's end with all its shuffles, until another comes: a small broadcast gives it one."""
    trim()
    spark.sparkContext.broadcast(None).destroy()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JJavaError:  # listeners lag: what they hold goes another time
        pass
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | Iterator[dict] | None]], schema: str) -> DataFrame:
    """mapInArrow with state per task: make() runs once in each task and returns a function from a batch to columns, or to several parts of columns one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                for part in () if out is None else (out,) if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_pydict(part)
        del step
        trim()

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """Rows of df, with all their columns, for which the function made by make() is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(step(batch)))
        del step
        trim()

    return df.mapInArrow(run, df.schema)


def sample_by_hash(df: DataFrame, group: str, key: str, per_group: int) -> DataFrame:
    """About per_group rows of each value of group (never above 1.25 times as many on average), by a hash of key: the same rows whatever the partitioning."""
    total = {r[0]: r[1] for r in df.groupBy(group).count().collect()}  # groups are classes: few
    if not total:
        return df.limit(0)
    rate = F.lit(0.0)
    for value, n in total.items():
        if value is not None:
            rate = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, per_group / n))).otherwise(rate)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 24)) / float(1 << 24)
    return df.where(u < rate)


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and in `count` how many of rows have it. Keys of at least one row in `share`, and the most frequent one, go by broadcast: there are share + 1 of them at most; all others by shuffle."""
    total, top = keyed.agg(F.sum(count), F.max_by(F.struct(*keys), F.struct(count, *keys))).first()
    if top is None:
        return rows.join(keyed, keys)
    most = reduce(lambda x, y: x & y, (F.col(k) == F.lit(top[k]) for k in keys))
    often = (F.col(count) * share >= F.lit(int(total))) | most
    hot, cold = keyed.where(often), keyed.where(~often)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def labelled(labels: DataFrame, label: str, held_out_mod: int, held_out_rest: int) -> DataFrame:
    """(doc_id, y) of the ids that are labelled 0 or 1 and aren't held out; where an id has both labels it is 1. Null ids are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return known.where(crc_mod("doc_id", held_out_mod) != held_out_rest).groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded_rows(rows: DataFrame, columns: list[str], most: int) -> Iterator[Row]:
    """The rows of a bounded sample, one for each doc_id, as long as their columns have `most` bytes together; which ones those are goes by hashes of doc_id and, of an id's several rows, of the rows. rows: as few ids as the sample allows, each with a doc_id."""
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.struct(F.xxhash64(*rows.columns), *columns)).alias("r")).select("r.*")  # ids of a bounded sample; a task keeps one row of each
    kept = stored(one)
    sizes = kept.select("doc_id", F.xxhash64("doc_id", F.lit(29)).alias("h"), sum((F.length(c) for c in columns), F.lit(0)).alias("n")).collect()  # a row for each id
    total, wanted = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["n"]
        if total <= most:
            wanted.append(r["doc_id"])
    if len(wanted) < len(sizes):
        kept = kept.where(F.col("doc_id").isin(wanted))
    return kept.toLocalIterator()
