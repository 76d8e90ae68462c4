"""Place embeddings: element-wise aggregation of image vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocurate.functions import vectors as V

REDUCTIONS: dict[str, Callable[[Column], Column]] = {"mean": V.mean_vector}


def place_embeddings(
    df: DataFrame,
    reduction: str | Callable[[Column], Column] = "mean",
    normalize: bool = True,
    vector: str = "embedding",
) -> DataFrame:
    """One vector per place: the mean of the raw image vectors, scaled to unit length.

    *reduction* may be an aggregate column function of the caller.  The aggregate
    combines map-side, so a place with a third of all images costs no more network
    than a small one.  A zero mean stays zero.
    """
    if isinstance(reduction, str):
        if reduction not in REDUCTIONS:
            raise ValueError(f"unknown reduction: {reduction!r}")
        reduction = REDUCTIONS[reduction]
    out = df.groupBy("place_id").agg(reduction(F.col(vector)).alias("embedding"))
    if normalize:
        out = out.withColumn("embedding", V.l2_normalize(F.col("embedding")))
    return out


def carried_embeddings(kept: DataFrame, normalize: bool = True) -> DataFrame:
    """Place vectors from the ``place_mean`` that the coherence filter left behind."""
    means = kept.filter(F.col("place_mean").isNotNull()).select(
        "place_id", F.col("place_mean").alias("embedding")
    )
    if normalize:
        means = means.withColumn("embedding", V.l2_normalize(F.col("embedding")))
    return means
