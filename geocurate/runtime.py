"""Session helpers: the shared working folder and materialised stages."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "geocurate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Vectors make wide rows, so Arrow batches are kept short.  Everything else is
    left to AQE (partition coalescing, skew-join splitting, run-time broadcast).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        # element-wise vector sums keep many keys in the map-side hash table
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, so that they find it wherever the session was started."""
    package = Path(__file__).resolve().parent
    name = f"{package.name}-{os.getpid()}.zip"
    if any(name in path for path in spark.sparkContext._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    made = shutil.make_archive(f"{folder}/{name.removesuffix('.zip')}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(made)  # Spark copies it to every executor


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (a local test session) is a fresh temporary folder taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/geocurate/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The path, and the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop_path(spark, path)
    return bool(fs.exists(target))


def qualified(spark: SparkSession, path: str) -> str:
    """Absolute form of *path* on its file system, without a trailing slash."""
    target, fs = hadoop_path(spark, path)
    return fs.makeQualified(target).toString().rstrip("/")


_created: list[str] = []


@dataclass
class Stage:
    """A DataFrame written to the shared folder; lineage ends here."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    target, fs = hadoop_path(spark, path)
    fs.delete(target, True)
    if path in _created:
        _created.remove(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stages of this process that are left, once no result needs them."""
    for path in list(_created):
        _delete(spark, path)


@contextmanager
def dropping_stages(spark: SparkSession):
    """Delete the stages written inside, but for those added to the list that is yielded."""
    before, kept = set(_created), []
    yield kept
    keep = before | {stage.path for stage in kept}
    for path in [p for p in _created if p not in keep]:
        _delete(spark, path)


def stage(df: DataFrame, label: str) -> Stage:
    """Write *df* as parquet in the shared folder and read it back.

    A written table survives the loss of any executor, and later plans read only
    the columns they need from it.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _created.append(path)
    return Stage(df.sparkSession.read.schema(df.schema).parquet(path), path)


#: Bytes in memory that a task of a wide shuffle is meant to sort.
TASK_BYTES = 128 << 20


def dealt(df: DataFrame, rows: int, row_bytes: int, *keys: str) -> DataFrame:
    """*df*, of about so many rows, by *keys* in as many partitions as keep a task's share from growing with the input.

    Where the session's number of partitions is enough, *df* is returned as it is and AQE chooses.
    """
    tasks = -(-rows * row_bytes // TASK_BYTES)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Lower the rows per Arrow batch while a stage of heavy rows is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
