"""Manifests from trees of image files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.functions import geo
from geocurate.functions import names as N
from geocurate.operators import checks
from geocurate.operators.ids import codes, dense_ids
from geocurate.runtime import qualified, stage
from geocurate.sources import listing


def scan_images(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(root, path) of every image file below the roots; file contents are not read.

    ``path`` is absolute and ``root`` the position of its root in the given list.
    """
    return list_images(spark, roots).select("root", "path")


def list_images(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """:func:`scan_images` with the length of each file and when it was changed."""
    return listing.list_files(spark, roots).filter(N.has_image_extension(F.col("path")))


def in_walk_order(paths: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Number the scanned files in the order of a sorted depth-first walk per root."""
    keyed = paths.withColumn("_walk", N.walk_key(F.col("path")))
    return dense_ids(keyed, ["root", "_walk"], id_col, unwritten=["_walk"])


def base_dirs(spark: SparkSession, *bases: str) -> list[str]:
    """Bases as they appear at the head of scanned paths."""
    return ["/" + q.split(":", 1)[1].lstrip("/") if q.startswith("file:") else q
            for q in (qualified(spark, b) for b in bases)]


def named_manifest(paths: DataFrame, source: str, *bases: str) -> DataFrame:
    """Manifest of files whose names carry position and heading."""
    parsed = in_walk_order(paths).withColumn("p", N.lenient_position(N.file_name(F.col("path"))))
    return parsed.select(
        "image_id", N.relative_path(F.col("path"), *bases).alias("image_path"),
        "p.utm_east", "p.utm_north", "p.heading", F.lit(source).alias("source"),
    )


def read_named(spark: SparkSession, roots: Sequence[str], source: str, base: str) -> DataFrame:
    """Training manifest of an image tree with ``@``-names; a heading is required."""
    manifest = named_manifest(scan_images(spark, roots), source, *base_dirs(spark, base))
    return checks.require_heading(manifest, source)


def read_sf_xl(spark: SparkSession, roots: Sequence[str], base: str, source: str = "sf_xl") -> DataFrame:
    return read_named(spark, roots, source, base)


def read_msls(spark: SparkSession, roots: Sequence[str], base: str, source: str = "msls") -> DataFrame:
    return read_named(spark, roots, source, base)


def pitts_manifest(
    paths: DataFrame, *bases: str, source: str = "pitts30k", cell_m: float = 15.0, angle_deg: float = 60.0
) -> DataFrame:
    """Manifest of panorama views with places from position and view direction.

    A malformed name fails the job with the name in the message.
    """
    parsed = in_walk_order(paths).withColumn("p", N.strict_pitts(N.file_name(F.col("path"))))
    message = F.concat(F.lit("malformed panorama name, "), F.col("p.problem"), F.lit(": "), F.col("path"))
    east = F.when(F.col("p.problem").isNotNull(), F.raise_error(message).cast("double")).otherwise(
        F.col("p.utm_east")
    )
    rows = stage(parsed.select(
        "image_id", N.relative_path(F.col("path"), *bases).alias("image_path"),
        east.alias("utm_east"), F.col("p.utm_north").alias("utm_north"), F.col("p.heading").alias("heading"),
        F.col("p.pitch_index").alias("pitch_index"), F.col("p.yaw_index").alias("yaw_index"),
        F.col("p.tile_num").alias("tile_num"), F.col("p.pano_id").alias("pano_id"),
        F.lit(source).alias("source"),
    ), "parsed").df
    binned = rows.select(
        "*", geo.cell(F.col("utm_east"), cell_m).alias("_e"), geo.cell(F.col("utm_north"), cell_m).alias("_n"),
        geo.wrapped_heading_bucket(F.col("heading"), angle_deg).alias("_h"),
    )
    bins = ["_e", "_n", "_h"]
    return binned.join(codes(binned, bins, "place_id"), bins).drop(*bins)


def malformed_pitts(paths: DataFrame) -> DataFrame:
    """Names that the strict parser rejects, with the reason."""
    parsed = N.strict_pitts(N.file_name(F.col("path")))
    return paths.select("path", parsed["problem"].alias("problem")).filter(F.col("problem").isNotNull())


def read_pitts(
    spark: SparkSession, roots: Sequence[str], base: str, cell_m: float = 15.0, angle_deg: float = 60.0,
    source: str = "pitts30k",
) -> DataFrame:
    manifest = pitts_manifest(
        scan_images(spark, roots), *base_dirs(spark, base), source=source, cell_m=cell_m, angle_deg=angle_deg
    )
    return checks.require_heading(manifest, source)


def eval_manifest(paths: DataFrame, *bases: str) -> DataFrame:
    """Query / database manifest: root 0 holds the queries, root 1 the database."""
    parsed = in_walk_order(paths).withColumn("p", N.lenient_position(N.file_name(F.col("path"))))
    return parsed.select(
        "image_id", N.relative_path(F.col("path"), *bases).alias("image_path"),
        (F.col("root") == 0).alias("is_query"), "p.utm_east", "p.utm_north",
    )


def read_eval(spark: SparkSession, query_root: str, database_root: str, base: str) -> DataFrame:
    return eval_manifest(scan_images(spark, [query_root, database_root]), *base_dirs(spark, base))
