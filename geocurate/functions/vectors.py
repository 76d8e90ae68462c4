"""Column functions on embedding vectors (array columns)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column, floor: float | None = None) -> Column:
    """Unit-length copy of *v* in double precision.

    With *floor* the vector is divided by ``max(norm, floor)``; without it a zero
    vector stays as it is.
    """
    length = norm(v)
    if floor is not None:
        divisor = F.greatest(length, F.lit(floor))
    else:
        divisor = F.when(length > 0, length).otherwise(F.lit(1.0))
    # one struct field per evaluation: the norm is computed once, not per element
    packed = F.transform(F.array(F.struct(v.alias("v"), divisor.alias("d"))), _scale)
    return F.element_at(packed, 1)


def _scale(row: Column) -> Column:
    return F.transform(row["v"], lambda x: x.cast("double") / row["d"])


def add_scaled(a: Column, b: Column, factor: float) -> Column:
    """``a + factor * b`` element by element."""
    return F.zip_with(a, b, lambda x, y: x + F.lit(factor) * y)


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean, combined map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def sum_vector(v: Column) -> Column:
    """Aggregate: element-wise sum, combined map-side."""
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def weighted_mean_vector(v: Column, weight: Column) -> Column:
    """Aggregate: element-wise weighted mean, combined map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(v), weight))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Cosine similarity with each norm bounded below by *floor*."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def sign_vector(v: Column) -> Column:
    """+1 where the element is >= 0, otherwise -1."""
    return F.transform(v, lambda x: F.when(x >= 0, F.lit(1)).otherwise(F.lit(-1)))


def sign_code(v: Column, width: int) -> Column:
    """Signs of a *width*-element vector packed into longs, lowest bit first."""
    words = []
    for start in range(0, width, 64):
        part = F.slice(v, start + 1, min(64, width - start))
        words.append(
            F.aggregate(
                F.transform(
                    part,
                    lambda x, i: F.when(x >= 0, _bit(i)).otherwise(F.lit(0).cast("long")),
                ),
                F.lit(0).cast("long"),
                lambda acc, x: acc.bitwiseOR(x),
            )
        )
    return F.array(*words)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two packed codes."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
