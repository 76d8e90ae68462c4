"""Listings of file trees as tables, made by the tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.runtime import hadoop_path, path_exists, qualified, stage

#: Stores that tasks can list themselves; in others Spark's own reader lists.
LISTED_BY_TASKS = ("file", "hdfs", "s3", "gs")

_FOUND = "root int, path string, folder boolean, length long, modified timestamp"


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(root, path, length, modified) of every file below the roots, each once, whatever its name begins with.

    ``root`` is the position of its root in the given list, ``path`` absolute.  A frontier of folders is listed level by
    level: each level is a job over the folders of the one before, whose result is written, so neither
    folders nor files pass through the driver.
    """
    starts = []
    for number, root in enumerate(roots):
        if not path_exists(spark, root):
            raise FileNotFoundError(f"root does not exist: {root}")
        starts.append((number, qualified(spark, root)))
    schemes = {re.match(r"([a-z0-9]+):", path)[1] for _, path in starts}
    if not schemes <= set(LISTED_BY_TASKS):
        return _listed_by_spark(spark, starts)
    frontier = spark.createDataFrame([(n, re.sub("^file:/+", "/", p)) for n, p in starts], "root int, path string")
    levels = []
    tasks = max(8, spark.sparkContext.defaultParallelism)
    while True:
        found = stage(frontier.repartition(tasks, "root", "path").mapInArrow(_children, _FOUND), "listing")
        if found.df.isEmpty():
            found.drop()
            break
        levels.append(found.df)
        frontier = found.df.filter("folder").select("root", "path")
    if not levels:
        return spark.createDataFrame([], "root int, path string, length long, modified timestamp")
    return reduce(DataFrame.unionByName, levels).filter("NOT folder").drop("folder")


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores: dict[str, pafs.FileSystem] = {"": pafs.LocalFileSystem()}
    names = ["root", "path", "folder", "length", "modified"]
    for batch in batches:
        for root, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            head = (re.match(r"[a-z0-9]+://[^/]*", path) or [""])[0]
            if head not in stores:
                stores[head] = pafs.FileSystem.from_uri(f"{head}/")[0]
            for info in _entries(stores[head], path.removeprefix(head)):
                at = info.mtime
                values = [root, f"{head}{info.path}", info.type == pafs.FileType.Directory, info.size, at]
                kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def _entries(store: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return store.get_file_info(pafs.FileSelector(folder or "/", recursive=False))


def _listed_by_spark(spark: SparkSession, starts: list[tuple[int, str]]) -> DataFrame:
    """The same through Spark's reader; names that it passes over are listed by the store's client on the driver."""
    parts = []
    for number, root in starts:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"))
        parts.append(files.select(F.lit(number).alias("root"), "path", "length", "modified"))
        if hidden := _passed_over(spark, root):
            parts.append(spark.createDataFrame([(number, *h) for h in hidden], "root int, path string, length long, ms long").select(
                "root", "path", "length", F.timestamp_millis("ms").alias("modified")
            ))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["root", "path"])


def _passed_over(spark: SparkSession, root: str) -> list[tuple[str, int, int]]:
    """Files that have, or lie in a folder with, a name that starts with ``_`` or ``.``."""
    top, fs = hadoop_path(spark, root)
    found, folders = [], [(top, False)]
    while folders:
        folder, hidden = folders.pop()
        for entry in fs.listStatus(folder):
            own = hidden or entry.getPath().getName()[0] in "_."
            if entry.isDirectory():
                folders.append((entry.getPath(), own))
            elif own:
                found.append((re.sub("^file:/+", "/", entry.getPath().toString()), entry.getLen(), entry.getModificationTime()))
    return found
