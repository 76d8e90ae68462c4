"""Manifest from per-city CSV files of street-view images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.functions import geo
from geocurate.functions import names as N
from geocurate.operators.checks import DataCheckError
from geocurate.operators.ids import dense_ids
from geocurate.runtime import hadoop_path, qualified
from geocurate.schemas import CITY_CSV

# Fixed value: distance between the place numbers of two cities.
CITY_PREFIX = 100_000


def read_city_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All city CSVs with the city of the file name and the place of each line in its file.

    A file block is read by one task, so (block, line) orders the lines of a file.
    """
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return (
        spark.read.schema(CITY_CSV).option("header", "true").option("pathGlobFilter", "*.csv").csv(folder)
        .select(
            "*", F.url_decode(stem).alias("file_city"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
    )


def selected_cities(available: Sequence[str], wanted: Sequence[str] | None) -> list[str]:
    """Sorted cities to read; a wanted city that is not available is an error."""
    if not wanted:
        return sorted(available)
    chosen = sorted({c.strip() for c in wanted if c.strip()})
    missing = [c for c in chosen if c not in set(available)]
    if missing:
        raise DataCheckError(f"cities not found: {missing}; available: {sorted(available)}")
    return chosen


def listed_cities(spark: SparkSession, folder: str) -> list[str]:
    """Cities that have a file, with or without lines."""
    top, fs = hadoop_path(spark, folder)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(top, "*.csv")
    return sorted(f.getPath().getName().removesuffix(".csv") for f in fs.globStatus(pattern) or ())


def city_ordinals(
    rows: DataFrame, wanted: Sequence[str] | None, available: Sequence[str] | None = None
) -> DataFrame:
    """(file_city, ordinal): one row per city, so the list is small.

    Without a list of the *available* files, cities are those that have rows.
    """
    if available is None:
        available = [r["file_city"] for r in rows.select("file_city").distinct().collect()]
    chosen = selected_cities(available, wanted)
    return rows.sparkSession.createDataFrame(
        list(enumerate(chosen)), "ordinal long, file_city string"
    )


def city_manifest(rows: DataFrame, ordinals: DataFrame, source: str = "gsvcities") -> DataFrame:
    """Manifest rows of the listed cities, with city-prefixed places and UTM positions.

    Images are numbered in city order, then in the order of the lines of a city file.
    """
    keys = ["ordinal", "block", "line"]
    numbered = dense_ids(rows.join(F.broadcast(ordinals), "file_city"), keys, "image_id")
    # paths and positions are made once, of the numbered lines: sorting samples what it is given
    east, north = geo.utm(F.col("lat"), F.col("lon"))
    path = N.city_image_path(
        F.col("city_id"), F.col("place_id"), F.col("year"), F.col("month"),
        F.col("northdeg"), F.col("lat"), F.col("lon"), F.col("panoid"),
    )
    return numbered.select(
        path.alias("image_path"),
        (F.col("place_id") + F.col("ordinal") * CITY_PREFIX).alias("place_id"),
        east.alias("utm_east"), north.alias("utm_north"),
        F.col("northdeg").cast("double").alias("heading"), F.lit(source).alias("source"), "image_id",
    )


def read_cities(
    spark: SparkSession, folder: str, cities: Sequence[str] | None = None, source: str = "gsvcities",
    image_root: str | None = None, base: str | None = None,
) -> DataFrame:
    """Manifest of the city files in *folder*, of all cities or of those named.

    A file without lines keeps its place among the prefixes.  With *image_root* and *base*
    the paths of images, which lie below the former, are given relative to the latter.
    """
    rows = read_city_csv(spark, folder)
    manifest = city_manifest(rows, city_ordinals(rows, cities, listed_cities(spark, folder)), source)
    if image_root is None or base is None:
        return manifest
    below = qualified(spark, image_root).removeprefix(qualified(spark, base) + "/")
    return manifest.withColumn("image_path", F.concat(F.lit(f"{below}/"), "image_path"))
