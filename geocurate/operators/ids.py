"""Dense identifiers without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocurate.runtime import stage

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_ids(df: DataFrame, keys: Sequence[str], id_col: str = "image_id", unwritten: Sequence[str] = ()) -> DataFrame:
    """Number the rows 0..n-1 in the total order of *keys*; the columns *unwritten* only serve that.

    The rows are range-partitioned and sorted, and written so that the order is
    settled before a number is given.  Only one row count per partition reaches the
    driver; the offsets go back as a broadcast of that many rows.
    """
    spark = df.sparkSession
    ordered = (
        df.drop(id_col)
        .repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
        .drop(*unwritten)
    )
    rows = stage(ordered, "ordered").df
    part = F.shiftright("_slot", _SLOT_BITS)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, before = [], 0
    for number, n in counts:
        offsets.append((number, before))
        before += n
    offset_table = spark.createDataFrame(offsets, "_part long, _before long")
    row = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        rows.withColumn("_part", part.cast("long"))
        .join(F.broadcast(offset_table), "_part")
        .withColumn(id_col, F.col("_before") + row)
        .drop("_part", "_before", "_slot")
    )


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], rank_col: str
) -> DataFrame:
    """Running number 0.. of each row inside its group.

    A group of any size is spread over the range partitions: the rank is the dense
    number over (group, order) minus the first number of the group.  The first numbers
    are written, so that Spark sees their size and broadcasts them only if small.
    """
    numbered = dense_ids(df, [*group, *order], rank_col)
    firsts = stage(numbered.groupBy(*group).agg(F.min(rank_col).alias("_first")), "firsts").df
    return (
        numbered.join(firsts, list(group))
        .withColumn(rank_col, F.col(rank_col) - F.col("_first"))
        .drop("_first")
    )


def codes(df: DataFrame, keys: Sequence[str], code_col: str) -> DataFrame:
    """Distinct keys with their 0-based code in key order."""
    return dense_ids(df.select(*keys).distinct(), keys, code_col)


def factorize(df: DataFrame, keys: Sequence[str], code_col: str) -> DataFrame:
    """Add the contiguous 0-based code of *keys*, ordered by key.

    Null is a key like any other and comes first, so no row is lost.
    """
    table = codes(df, keys, "_code").select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_code")
    same = reduce(Column.__and__, [df[k].eqNullSafe(table[f"_key_{i}"]) for i, k in enumerate(keys)])
    return (
        df.join(table, same)
        .withColumn(code_col, F.col("_code"))
        .drop("_code", *[f"_key_{i}" for i in range(len(keys))])
    )


def sampled_keys(
    df: DataFrame, keys: Sequence[str], fraction: float, seed: int
) -> DataFrame:
    """Keep ``max(1, int(n * fraction))`` of the distinct keys, chosen by hash order."""
    distinct = df.select(*keys).distinct().withColumn("_h", sample_hash(seed, *keys))
    numbered = dense_ids(distinct, ["_h", *keys], "_rank")
    n = numbered.count()
    keep = max(1, int(n * fraction))
    return numbered.filter(F.col("_rank") < keep).select(*keys)


def sample_hash(seed: int, *keys: str):
    """Deterministic random order of keys, the same on every engine with md5."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def offset_by_existing(new: DataFrame, existing: DataFrame, id_col: str) -> DataFrame:
    """Shift the ids of *new* past the largest id of *existing*."""
    top = existing.agg(F.max(id_col)).scalar()
    return new.withColumn(id_col, (F.col(id_col) + F.coalesce(top + 1, F.lit(0))).cast("long"))
