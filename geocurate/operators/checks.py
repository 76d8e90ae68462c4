"""Fail-fast checks.  Each runs one aggregate job and raises with the count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocurate.runtime import dealt


class DataCheckError(ValueError):
    """A table does not meet the contract of an operator."""


def is_missing(column: str) -> Column:
    """Null or NaN."""
    return F.col(column).isNull() | F.isnan(F.col(column))


def missing_heading_count(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(is_missing("heading")).alias("missing"), F.count("*").alias("total")
    )


def require_heading(df: DataFrame, label: str) -> DataFrame:
    row = missing_heading_count(df).first()
    if row["missing"]:
        raise DataCheckError(
            f"{label}: {row['missing']} of {row['total']} images are missing a heading value"
        )
    return df


def require_position(df: DataFrame, label: str) -> DataFrame:
    row = df.agg(F.count_if(is_missing("utm_east") | is_missing("utm_north")).alias("missing"), F.count("*").alias("total")).first()
    if row["missing"]:
        raise DataCheckError(f"{label}: {row['missing']} of {row['total']} images have no position")
    return df


def missing_keys(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of *df* that *reference* does not hold."""
    return df.select(*keys).distinct().join(reference.select(*keys), list(keys), "left_anti")


def require_keys(df: DataFrame, reference: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    n = missing_keys(df, reference, keys).count()
    if n:
        raise DataCheckError(f"{n} {label} not found in the embedding table")
    return df


#: Bytes in memory of the keys of an image, about: two sides hold them, to count and to sort.
_KEY_BYTES = 640


def vector_faults(images: DataFrame, store: DataFrame, keys: Sequence[str], rows: int = 0) -> DataFrame:
    """One row: distinct keys of *images* that have no vector in *store*, or more than one.

    Only keys are read and shuffled, never vectors.  With the number of images in *rows* a task's share is bounded.
    """
    share = lambda df: dealt(df.select(*keys), rows, _KEY_BYTES, *keys)
    held = share(store).groupBy(*keys).agg(F.count("*").alias("_held"))
    wanted = share(images).distinct().join(held, list(keys), "left")
    return wanted.agg(
        F.count("*").alias("wanted"), F.count_if(F.col("_held").isNull()).alias("missing"),
        F.count_if(F.col("_held") > 1).alias("doubled"),
    )


def require_vectors(images: DataFrame, store: DataFrame, keys: Sequence[str], label: str, rows: int = 0) -> None:
    """Every image has exactly one stored vector."""
    row = vector_faults(images, store, keys, rows).first()
    if row["missing"] or row["doubled"]:
        raise DataCheckError(
            f"{label}: of {row['wanted']} images {row['missing']} have no vector, {row['doubled']} have several"
        )


def mixed_batches(samples: DataFrame) -> DataFrame:
    """Batches that hold more than one supergroup."""
    return (
        samples.groupBy("batch_id")
        .agg(F.min("supergroup_id").alias("low"), F.max("supergroup_id").alias("high"))
        .filter(F.col("low") < F.col("high"))
    )


def require_pure_batches(samples: DataFrame) -> DataFrame:
    n = mixed_batches(samples).count()
    if n:
        raise DataCheckError(f"{n} batches mix supergroups")
    return samples


def require_fraction(fraction: float) -> float:
    if not 0.0 < fraction <= 1.0:
        raise DataCheckError(f"fraction must be in (0, 1], got {fraction}")
    return fraction


def require_images_per_place(images: DataFrame, per_place: int, keys: Sequence[str]) -> DataFrame:
    """Strict mode: no place may hold fewer images than are drawn from it."""
    smallest = (
        images.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.min("n").alias("low")).first()["low"]
    )
    if smallest is not None and smallest < per_place:
        raise DataCheckError(
            f"images_per_place={per_place} exceeds the smallest place with {smallest} images"
        )
    return images


def city_prefix_collisions(df: DataFrame, prefix: int) -> DataFrame:
    """City rows whose own place number reaches into the next city's prefix."""
    return df.filter(F.col("place_id") >= prefix)
