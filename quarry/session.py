"""Session helpers: builder for local use and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may do without: then it is a temporary folder, which goes with the process. On a cluster executors couldn't see that folder, so the lack is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new path under the shared scratch folder; what is written there goes with the process, or with drop_scratch()."""
    path = f"{checkpoint_root(spark)}/quarry-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: [drop_scratch(s) for s in [SparkSession.getActiveSession()] if s])
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application; results that still read them are void then."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            return


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and reads it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that stored() returned, once nothing that is still to run reads it."""
    _delete(df.sparkSession, df.scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the generated tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
