"""Bounded blocks of rows, and exact work on pairs of blocks.

Pairwise questions (nearest centroid, neighbour search, distances inside a group)
are answered on blocks of at most a few megabytes.  A group of any size becomes
many blocks, and the pairs of blocks are keyed one by one, so that they spread over
the cluster.  The functions that read a pair of blocks return aggregates or top-k
rows, never the pairs themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.runtime import arrow_rows, new_path, stage

BLOCK_VALUES = 2_000_000
BLOCK_ROWS = 2048

#: Arrow batches of block rows: 8 pairs of blocks at a time.
BATCH_BLOCKS = 8


def rows_per_block(dim: int) -> int:
    return int(max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, dim))))


def vector_size(df: DataFrame, vector: str) -> int:
    head = df.select(F.size(vector).alias("d")).first()
    return head["d"] if head else 0


def pack(
    df: DataFrame, group: Sequence[str], id_col: str, values: Sequence[str], rows: int,
    one_block: bool = False,
) -> DataFrame:
    """Blocks of about *rows* rows: (group..., blk, nblk, rows array<struct>).

    The block of a row is a hash of its id, so a hot group is spread without a sort.
    The block counts are written, so that Spark sees their size: while they are small
    they are broadcast and the rows are shuffled once, by block.
    With *one_block* the caller knows that no group exceeds a block.
    """
    content = F.array_sort(
        F.collect_list(F.struct(F.col(id_col).alias("id"), *[F.col(v) for v in values]))
    ).alias("rows")
    if one_block:
        packed = df.groupBy(*group).agg(content)
        return packed.select(*group, F.lit(0).alias("blk"), F.lit(1).alias("nblk"), "rows")
    sizes = stage(
        df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("nblk")), "block_counts"
    ).df
    return (
        df.join(sizes, list(group))
        .withColumn("blk", F.pmod(F.xxhash64(id_col), F.col("nblk")).cast("int"))
        .groupBy(*group, "blk", "nblk")
        .agg(content)
    )


@dataclass
class BlockTable:
    """Blocks written as a table bucketed by their keys: a join on the keys leaves them where they are."""

    df: DataFrame
    name: str

    @classmethod
    def write(cls, packed: DataFrame, keys: Sequence[str], label: str) -> BlockTable:
        spark = packed.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name, path = f"{label}_{uuid.uuid4().hex}", new_path(spark, label)
        with arrow_rows(spark, BATCH_BLOCKS):
            writer = packed.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
            writer.option("path", path).saveAsTable(name)
        return cls(spark.table(name), name)

    def drop(self) -> None:
        """Forget the table; its files stay in the shared folder until that is cleared."""
        self.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def pair_up(
    blocks: DataFrame, group: Sequence[str], ordered: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Join the blocks of each group pairwise: columns ``left`` and ``right``.

    Without *ordered* each unordered pair (and each block with itself) comes once.
    Both sides are keyed by (group, i, j), so no key meets more than two blocks.
    *carry* names block columns that the left side brings along.
    """
    low = F.lit(0) if ordered else F.col("blk")
    high = F.col("nblk") - 1 if ordered else F.col("blk")
    left = blocks.select(
        *group,
        F.col("blk").alias("i"),
        F.explode(F.sequence(low, F.col("nblk") - 1)).alias("j"),
        F.col("rows").alias("left"),
        *carry,
    )
    right = blocks.select(
        *group,
        F.explode(F.sequence(F.lit(0), high)).alias("i"),
        F.col("blk").alias("j"),
        F.col("rows").alias("right"),
    )
    return left.join(right, [*group, "i", "j"])


def fields(block: pa.ListScalar) -> pa.StructArray:
    """The rows of one block."""
    return block.values


def column(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def matrix(rows: pa.StructArray, name: str, dtype=np.float64) -> np.ndarray:
    part = rows.field(name)
    flat = part.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=dtype).reshape(len(part), -1)


def unit_rows(x: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), floor)


def per_row(
    fn: Callable[[dict], dict | None], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply *fn* to each row of block data; it returns columns of result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index in range(batch.num_rows):
                row = {name: batch.column(name)[index] for name in batch.schema.names}
                result = fn(row)
                if result is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(result[f.name], type=f.type) for f in schema], schema=schema
                    )

    return run
