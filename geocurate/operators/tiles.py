"""Every row of a group against every other, with each row moved about once.

A task holds one part of a group, up to a fixed number of vector elements, while all rows of the group
stream past it in the order of their ids.  A group that fits a part is moved twice, whatever its number of
pairs; a larger one once more per part.  Parts grow with the input until they fill a task, as more of them
than the cluster has room for would only be more copies.  What leaves a task is what the caller makes of the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.operators import blocks as B
from geocurate.runtime import stage

#: Most vector elements of the part that a task holds (double precision: 64 MB).
HELD_VALUES = 8_000_000
#: Rows of a part where the input is small, and parts for each core where it is large.
HELD_ROWS = 8_192
CORE_PARTS = 2
#: Cells of a tile that is looked at in one step, and most rows that stream past in one.
TILE_CELLS = 1 << 19
TILE_ROWS = 512


def held_rows(dim: int, rows: int, cores: int) -> int:
    """Rows that a task holds of so many with vectors of *dim* elements."""
    return int(max(1, min(HELD_VALUES // max(1, dim), max(HELD_ROWS, -(-rows // (CORE_PARTS * cores))))))


def against_all(
    df: DataFrame, group: str, values: Sequence[str], reducer: Callable, schema: pa.Schema, ddl: str,
    dim: int, rows: int | None = None, held: int | None = None,
) -> DataFrame:
    """Run *reducer* on each part of each group of *df*: (group, sample_id, embedding of *dim* elements, values...).

    ``reducer(key, part)`` returns an object whose ``tile(at, n, right)`` is called for held rows ``at`` to
    ``at + n`` and each record batch *right* of at most *rows* rows of the group, and ``end()`` after the last;
    both yield columns of result rows.  *part* is a record batch of at most about *held* rows (:func:`held_rows`).
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = min(rows or TILE_ROWS, TILE_ROWS)
    step = max(1, TILE_CELLS // rows)
    names = ["sample_id", "embedding", *values]
    sizes = stage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")), "part_counts").df
    held = held or held_rows(dim, sizes.agg(F.sum("_rows")).first()[0] or 0, cores)
    parts = F.ceil(F.col("_rows") / F.lit(held)).cast("int").alias("_parts")
    counted = df.select(group, *names).join(sizes.select(group, parts), group)
    own = counted.withColumn("_part", F.pmod(F.xxhash64("sample_id"), F.col("_parts")).cast("int"))
    every = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    both = own.select(group, "_part", F.lit(0).alias("_side"), *names).unionByName(every.select(group, "_part", F.lit(1).alias("_side"), *names))
    # as many tasks as the cluster has room for: a task's work grows with its pairs, not its bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    ordered = both.repartition(tasks, group, "_part").sortWithinPartitions(group, "_part", "_side", "sample_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(result: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(result[f.name], type=f.type) for f in schema], schema=schema)

        key, pieces, state, n = None, [], None, 0
        for batch in batches:
            for mine, side, piece in runs(batch, (group, "_part", "_side")):
                if mine != key:
                    if state is not None:
                        yield from map(table, state.end())
                    key, pieces, state = mine, [], None
                if side == 0:
                    pieces.append(piece)
                    continue
                if not pieces and state is None:
                    continue  # a part that no row is dealt to
                if state is None:
                    part = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
                    n, pieces, state = part.num_rows, [], reducer(mine[0], part)
                for low in range(0, piece.num_rows, rows):
                    right = piece.slice(low, rows)
                    for at in range(0, n, step):
                        yield from map(table, state.tile(at, min(step, n - at), right))
        if state is not None:
            yield from map(table, state.end())

    return ordered.mapInArrow(run, ddl)


def runs(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[tuple[int, ...], int, pa.RecordBatch]]:
    """Slices of a sorted batch that share the columns *names*, with the values of those: all but the last, and the last."""
    if not batch.num_rows:
        return
    keys = [batch.column(c).to_numpy() for c in names]
    new = np.zeros(batch.num_rows - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield tuple(int(k[a]) for k in keys[:-1]), int(keys[-1][a]), batch.slice(a, b - a)


def units(rows: pa.RecordBatch, floor: float = 1e-12) -> np.ndarray:
    """Unit vectors of a record batch."""
    x = np.asarray(rows.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64)
    return B.unit_rows(x.reshape(rows.num_rows, -1), floor)
