"""Tables that change without being rewritten: base and delta files, merged when they are read, behind a version that switches at once.

A version is a small file that lists data folders. Writers put their data into new folders first and then create the next version's file, which must not exist yet: readers see the old version or the new one, a writer that is lost leaves files that no version names, and of two writers at once the second fails and may try again. Nothing is changed in place; old versions stay readable until vacuum().
All file access goes through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer made the next version first."""


@dataclass
class Versions:
    """The versions of a folder: numbered JSON files."""

    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def latest(self) -> int:
        """0 if there is none."""
        fs, path = self._fs()
        at = path(f"{self.root}/versions")
        if not fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, version: int | None = None) -> dict:
        """What a version lists, the latest by default; an empty dict for version 0."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/versions/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, after: int, content: dict) -> int:
        """Makes the version that follows `after`; Conflict if it is there already. The file is written under another name and renamed, which fails where there is one."""
        fs, path = self._fs()
        goal, draft = path(f"{self.root}/versions/{after + 1:08d}.json"), path(f"{self.root}/versions/draft-{uuid.uuid4().hex}")
        fs.mkdirs(goal.getParent())
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if fs.exists(goal) or not fs.rename(draft, goal):
            fs.delete(draft, False)
            raise Conflict(f"version {after + 1} of {self.root} was made by another writer")
        return after + 1

    def folder(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def vacuum(self) -> int:
        """Deletes data that the latest version doesn't list, and the versions before it; only while nobody writes. The number of folders deleted."""
        fs, path = self._fs()
        last = self.latest()
        kept, gone = json.dumps(self.read(last)), 0
        at = path(f"{self.root}/data")
        for f in fs.listStatus(at) if fs.exists(at) else ():
            if f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)
                gone += 1
        for f in fs.listStatus(path(f"{self.root}/versions")):
            if f.getPath().getName() != f"{last:08d}.json":
                fs.delete(f.getPath(), False)
        return gone


class MergedTable:
    """A table with unique keys. merge() appends a delta of puts and deletes; read() lays the deltas over the base.

    Of a key's changes the last one counts (by delta, then by `order`). A put replaces all columns but `first`, which stay as they were first written since the key's last delete. Only keys that deltas name are folded; the rest of the base passes an anti join with them, which Spark broadcasts while they are few.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], first: tuple[str, ...] = ()) -> None:
        self.spark, self.key, self.first, self.versions = spark, key, first, Versions(spark, root.rstrip("/"))

    def create(self, rows: DataFrame) -> int:
        """The first version; rows have unique keys."""
        return self._write(0, rows)

    def _write(self, after: int, rows: DataFrame) -> int:
        path = self.versions.folder()
        rows.write.parquet(path)
        return self.versions.commit(after, {"base": path, "deltas": [], "schema": rows._jdf.schema().json()})

    def merge(self, changes: DataFrame, order: Column, delete: Column | None = None) -> int:
        """A version with these changes: the table's columns, an order among changes of one key, and where a change deletes the key."""
        last = self.versions.latest()
        now = self.versions.read(last)
        path = self.versions.folder()
        changes.withColumns({"__order": order, "__delete": F.lit(False) if delete is None else F.coalesce(delete, F.lit(False))}).write.parquet(path)
        return self.versions.commit(last, now | {"deltas": [*now["deltas"], path]})

    def clear(self) -> int:
        """A version without rows."""
        last = self.versions.latest()
        return self._write(last, self.read(last).limit(0))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        now = self.versions.read(version)
        base = self.spark.read.parquet(now["base"])
        if not now["deltas"]:
            return base
        columns = base.columns
        changes = None
        for i, path in enumerate(now["deltas"], 1):
            part = self.spark.read.parquet(path).select(*columns, F.struct(F.lit(i).alias("n"), F.col("__order").cast("string").alias("s"), F.col("__order").cast("double").alias("o")).alias("__at"), "__delete")
            changes = part if changes is None else changes.unionByName(part)
        at = lambda c: F.struct(c["n"], c["o"], c["s"])
        keys = changes.select(*self.key).distinct()
        same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.key]
        touched = base.alias("b").join(keys.alias("k"), same("b", "k"), "left_semi").select(*columns, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("o")).alias("__at"), F.lit(False).alias("__delete"))
        events = touched.unionByName(changes).withColumn("__at", at(F.col("__at")))
        gone = events.groupBy(*self.key).agg(F.max(F.when(F.col("__delete"), F.col("__at"))).alias("__gone"))
        left = events.alias("e").join(gone.alias("g"), same("e", "g")).where("__gone is null or __at > __gone").select(*[F.col(f"e.{c}") for c in columns], "__at")
        rest = [c for c in columns if c not in self.key and c not in self.first]
        folded = left.groupBy(*self.key).agg(*[F.min_by(c, "__at").alias(c) for c in self.first], F.max_by(F.struct(F.lit(0).alias("__x"), *rest), "__at").alias("__v"))
        merged = folded.select(*[F.col(f"__v.{c}").alias(c) if c in rest else F.col(c) for c in columns])
        return base.alias("b").join(keys.alias("k"), same("b", "k"), "left_anti").unionByName(merged)

    def compact(self) -> int:
        """A version whose base holds what is read now."""
        last = self.versions.latest()
        return self._write(last, self.read(last))


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """df as a table dealt and sorted by its keys, in the session's warehouse. Tables with the same keys and number of buckets are joined and grouped by these keys without a shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
