"""File sources and sinks: CSV, JSON lines with line errors, JSON documents, canonical JSON lines, exclusive and atomic writes, run folders."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """All columns as text; quoted fields may hold line ends. ValueError if required columns lack."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    lacking = [c for c in required or [] if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.select(*required) if required else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON objects, blank lines left out; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): every line with its number in its file, blank ones included.

    Files are read in splits like any text. A split's lines come in order, so a line's number is its place in the split and the lines of the splits before it, which are counted in a first pass: one row for each split.
    """
    meta = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            n = []
            for key in zip(b["path"].to_pylist(), b["at"].to_pylist()):
                seen[key] = seen.get(key, 0) + 1
                n.append(seen[key])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n"])

    placed = meta.mapInArrow(places, "value string, path string, at long, n long")
    sizes = meta.groupBy("path", "at").agg(F.count("*").alias("lines"))
    before = sizes.select("path", "at", F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(before, ["path", "at"]).select("path", (F.col("before") + F.col("n")).alias("line"), "value")


def jsonl_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, error) of lines that aren't JSON objects of the schema; blank lines are none."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.when(~F.trim("value").startswith("{"), "not an object").when(F.col("row").isNull() | F.col("row._bad").isNotNull(), "invalid JSON or types")
    return parsed.withColumn("error", bad).where("error is not null").select("path", "line", "error")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A relational table; with a numeric key and its bounds it is read in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(movie_key, tags) of a label file: of a key that occurs twice the last line counts, absent tags are none, a file that doesn't exist has no rows."""
    empty = spark.createDataFrame([], "movie_key string, tags array<string>")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return empty
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("r", F.from_json("value", "movie_key string, film_mood_tags array<string>", {"mode": "FAILFAST"}))
    return rows.groupBy(F.col("r.movie_key").alias("movie_key")).agg(F.max_by(F.coalesce("r.film_mood_tags", F.array().cast("array<string>")), "line").alias("tags"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Canonical lines: keys in order of columns (sorted without `order`), nulls written."""
    names = order or sorted(df.columns)
    df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_small(path: str, value: Any) -> None:
    """A small driver-side JSON or text file, whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(value if isinstance(value, str) else json.dumps(value, indent=2) + "\n")
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_new(path: str, text: str) -> None:
    """FileExistsError where there is a file."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)


#: fixed values: names of runs and of their stages
RUN_NAME, RUN_TIME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*"), re.compile(r"\d{4}-\d{2}-\d{2}-\d{4}([-_].*)?")
STAGES = ("start", "candidates_done", "silver_done", "provisional_metrics_done")


def _utc(now: datetime | None) -> datetime:
    now = now or datetime.now(timezone.utc)
    return now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)


def stamp(now: datetime | None = None) -> str:
    """The time in UTC to the second, ending in Z."""
    return _utc(now).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_run(now: datetime | None = None) -> str:
    return f"{_utc(now):%Y-%m-%d-%H%M}-nogit"


class Runs:
    """Run folders below a root on the driver: manifest, settings, warnings, stage times. Small JSON files, written whole or not at all."""

    def __init__(self, root: str) -> None:
        self.root = root

    def folder(self, run: str) -> str:
        """The run's path; ValueError for a name that could leave the root."""
        if not isinstance(run, str) or ".." in run or not RUN_NAME.fullmatch(run):
            raise ValueError("a run's name has letters, digits, dots, dashes and underscores only")
        return os.path.join(self.root, run)

    def ensure(self, run: str) -> str:
        os.makedirs(self.folder(run), exist_ok=True)
        return self.folder(run)

    def manifest(self, run: str) -> dict:
        with open(os.path.join(self.folder(run), "run_manifest.json"), encoding="utf-8") as f:
            found = json.load(f)
        if not isinstance(found, dict):
            raise ValueError("run_manifest.json must contain an object")
        return found

    def _save(self, run: str, manifest: dict) -> dict:
        write_small(os.path.join(self.ensure(run), "run_manifest.json"), manifest)
        return manifest

    def start(self, run: str, settings: dict | None = None, seed: int = 42, now: datetime | None = None, **more: Any) -> dict:
        """Writes a new manifest; `more` overrides its entries, times are added to its own."""
        rows = (settings or {}).get("DATASET_ROW_COUNT")
        models = {n: (settings or {}).get(n.upper()) for n in ("embedding_model", "reranker_model", "llm_model")}
        times = dict.fromkeys(STAGES) | {"start": stamp(now)} | more.pop("timestamps", {})
        own = {"run_id": run, "git_sha": None, "git_dirty": None, "git_mode": "no_git", "dataset_row_count": rows, "chroma_collection_count": rows, **models, "rng_seed": seed, "warnings": [], "timestamps": times}
        return self._save(run, own | more)

    def settings(self, run: str, module: Any) -> dict:
        """Writes a module's settings beside the manifest."""
        found = snapshot(module)
        write_small(os.path.join(self.ensure(run), "config_snapshot.json"), found)
        return found

    def warn(self, run: str, message: str) -> dict:
        manifest = self.manifest(run)
        if not isinstance(message, str) or not isinstance(manifest.setdefault("warnings", []), list):
            raise ValueError("a warning is a text, and warnings are a list")
        manifest["warnings"].append(message)
        return self._save(run, manifest)

    def done(self, run: str, stage: str, now: datetime | None = None) -> dict:
        """Notes the time of a stage."""
        if stage not in STAGES:
            raise ValueError(f"stage must be one of: {', '.join(sorted(STAGES))}")
        manifest = self.manifest(run)
        if not isinstance(manifest.setdefault("timestamps", {}), dict):
            raise ValueError("timestamps must be an object")
        manifest["timestamps"][stage] = stamp(now)
        return self._save(run, manifest)

    def latest(self) -> str:
        """The run that current_run.txt names, else the last folder by name that begins with a time."""
        pointer = os.path.join(self.root, "current_run.txt")
        if os.path.exists(pointer):
            with open(pointer, encoding="utf-8") as f:
                run = f.read().strip()
            self.folder(run)
            return run
        names = [n for n in os.listdir(self.root) if os.path.isdir(os.path.join(self.root, n))] if os.path.isdir(self.root) else []
        found = max((n for n in names if RUN_TIME.fullmatch(n)), default=None)
        if found is None:
            raise FileNotFoundError(f"no run folders in {self.root}")
        return found


@contextmanager
def timed(stage: str, took: dict[str, float]) -> Iterator[None]:
    """Adds the seconds of a block to took[stage], also if it fails. A lazy plan takes its time where it is run."""
    began = time.perf_counter()
    try:
        yield
    finally:
        took[stage] = took.get(stage, 0.0) + time.perf_counter() - began


def snapshot(module) -> dict:
    """Upper-case settings of a module in JSON types."""

    def plain(v: Any) -> Any:
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple, set, frozenset)):
            return [plain(x) for x in (sorted(v, key=str) if isinstance(v, (set, frozenset)) else v)]
        return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)

    return {k: plain(getattr(module, k)) for k in dir(module) if k.isupper()}
