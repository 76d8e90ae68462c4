"""Coherence of the images of a place, and the iterative filter on it.

With unit vectors u and the place sum s, the mean cosine of image i to the other
n-1 images is ``(u_i.s - u_i.u_i) / (n - 1)``.  No pair of images is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocurate.functions import vectors as V
from geocurate.operators import places
from geocurate.runtime import arrow_rows, dealt, stage

#: Bytes of a row beside its vector, about.
_ROW_BYTES = 256
_EPS = 1e-12  # floor of the norm when similarities are taken

#: A place is filtered inside one task while it holds at most this many vector
#: elements (double precision: 128 MB).  Larger places take the distributed rounds.
MAX_TASK_VALUES = 16_000_000


def coherence(
    df: DataFrame, vector: str = "embedding", keep_vector: bool = False,
    max_task_values: int = MAX_TASK_VALUES,
) -> DataFrame:
    """Add ``coherence``: mean cosine to the other images of the place (null if alone).

    Places that fit a task are scored there, from one shuffle on ``place_id``.  For
    larger ones the place sum is aggregated map-side and joined back.
    """
    small, large = _by_size(df, vector, max_task_values)
    scored = _stream_scores(small, vector, keep_vector)
    if large is None:
        return scored
    rest = _joined_scores(large, vector)
    return scored.unionByName(rest if keep_vector else rest.drop(vector))


def _by_size(
    df: DataFrame, vector: str, max_task_values: int, manifest: DataFrame | None = None, width: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of places that fit a task, dealt by place, and rows of larger places (None if there are none).

    Nothing is written but the large places' numbers: a join below *df* is read by each part for its own rows.
    """
    width = width or _width(df, vector)
    is_large = F.col("num_images") > task_rows(width, max_task_values)
    sizes = places.place_sizes(df if manifest is None else manifest)
    rows, n_large = sizes.agg(F.coalesce(F.sum("num_images"), F.lit(0)), F.count_if(is_large)).first()
    by_place = lambda part: dealt(part.repartition("place_id"), rows, 8 * width + _ROW_BYTES, "place_id")
    if not n_large:
        return by_place(df), None
    large = stage(sizes.filter(is_large).select("place_id"), "large_places").df
    return by_place(df.join(large, "place_id", "left_anti")), df.join(large, "place_id", "left_semi")


def task_rows(dim: int, max_task_values: int = MAX_TASK_VALUES) -> int:
    return max(2, max_task_values // max(1, dim))


def _joined_scores(df: DataFrame, vector: str) -> DataFrame:
    unit = df.withColumn("_u", V.l2_normalize(F.col(vector), _EPS))
    sums = unit.groupBy("place_id").agg(
        F.count("*").alias("_n"), V.sum_vector(F.col("_u")).alias("_s")
    )
    own = V.dot(F.col("_u"), F.col("_u"))
    score = (V.dot(F.col("_u"), F.col("_s")) - own) / (F.col("_n") - 1)
    return (
        unit.join(sums, "place_id")
        .withColumn("coherence", F.when(F.col("_n") > 1, score))
        .drop("_u", "_s", "_n")
    )


def _stream_scores(df: DataFrame, vector: str, keep_vector: bool) -> DataFrame:
    """Scores of rows that are dealt by place."""
    out = [f for f in df.schema.fields if keep_vector or f.name != vector]
    names = [f.name for f in out]
    ordered = df.sortWithinPartitions("place_id", "image_id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_places(batches):
            u, parts = _units(table, vector)
            score = np.full(len(u), np.nan)
            for rows in parts:
                if len(rows) > 1:
                    x = u[rows]
                    score[rows] = (x @ x.sum(axis=0) - np.einsum("ij,ij->i", x, x)) / (len(rows) - 1)
            column = pa.array(score, from_pandas=True)
            yield from table.select(names).append_column("coherence", column).to_batches()

    schema = T.StructType([*out, T.StructField("coherence", T.DoubleType())])
    return ordered.mapInArrow(scored, schema)


def coherence_filter(
    df: DataFrame,
    tau: float = 0.3,
    min_images: int = 2,
    vector: str = "embedding",
    keep_vector: bool = False,
    max_task_values: int = MAX_TASK_VALUES,
    round_candidates: int = 4096,
    place_mean: bool = False,
    manifest: DataFrame | None = None,
    width: int | None = None,
) -> DataFrame:
    """Drop the least coherent image of each place until every image reaches *tau*.

    After each drop the remaining images are scored again.  Ties go to the smallest
    image id.  Places left with fewer than *min_images* images are removed.

    With *place_mean* the first survivor of a place carries the mean of the raw
    vectors of all survivors in ``place_mean`` (null on the others), so that place
    embeddings need no second pass over the vectors.

    Places that fit a task are filtered there, streamed from one shuffle on
    ``place_id``.  Larger places never meet in one task: see :mod:`elimination`.

    Where *df* is a join with a store of vectors, *manifest* is its narrow side, from which
    the places are counted, and *width* the length of a vector; then the join runs once.
    """
    from geocurate.operators import elimination  # it builds on this module

    width = width or _width(df, vector)
    small, large = _by_size(df, vector, max_task_values, manifest, width)
    kept = _stream(small, tau, min_images, vector, keep_vector, place_mean)
    if large is None:
        return kept
    blocks = elimination.place_blocks(large, vector, width)
    drops = elimination.dropped(
        blocks, tau, min(round_candidates, task_rows(width, max_task_values)), elimination.round_limit(width)
    )
    rest = large if keep_vector or manifest is None else manifest.join(blocks.df.select("place_id"), "place_id", "left_semi")
    rest = places.min_images(rest.join(drops, ["place_id", "image_id"], "left_anti"), min_images)
    if place_mean:
        means = elimination.block_means(blocks, drops, [tau])
        rest = rest.join(means, ["place_id", "image_id"], "left").withColumn("place_mean", F.get("place_means", F.lit(0))).drop("place_means")
    return kept.unionByName(rest if keep_vector else rest.drop(vector))


def _width(df: DataFrame, vector: str) -> int:
    head = df.select(F.size(vector).alias("d")).first()
    return head["d"] if head else 1


# -- places that fit a task ---------------------------------------------------


def _stream(
    df: DataFrame, tau: float, min_images: int, vector: str, keep_vector: bool, place_mean: bool
) -> DataFrame:
    out = [f for f in df.schema.fields if keep_vector or f.name != vector]
    names = [f.name for f in out]
    ordered = df.sortWithinPartitions("place_id", "image_id")

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_places(batches):
            keep, means = _keep_mask(table, vector, tau, min_images, place_mean)
            kept = table.select(names)
            if place_mean:
                column = pa.array(means, type=pa.list_(pa.float64()))
                kept = kept.append_column("place_mean", column)
            yield from kept.filter(pa.array(keep)).to_batches()

    if place_mean:
        out = [*out, T.StructField("place_mean", T.ArrayType(T.DoubleType()))]
    return ordered.mapInArrow(survivors, T.StructType(out))


def _whole_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no place is split between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        place = batch.column("place_id").to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(place, place[-1], side="left"))
        if held and held[-1].column("place_id")[-1].as_py() != place[0]:
            yield pa.Table.from_batches(held)
            held = []
        if start > 0:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(rows, -1)


def _units(table: pa.Table, vector: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Unit vectors of a table of whole places, and the rows of each place."""
    x = _matrix(table.column(vector), table.num_rows)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), _EPS), _parts(table)


def _parts(table: pa.Table) -> list[np.ndarray]:
    place = table.column("place_id").to_numpy()
    return np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1)


def _keep_mask(
    table: pa.Table, vector: str, tau: float, min_images: int, place_mean: bool
) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which rows stay, and the mean raw vector on the first survivor of each place."""
    raw = _matrix(table.column(vector), table.num_rows)
    u = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), _EPS)
    keep = np.zeros(len(u), dtype=bool)
    means: list[np.ndarray | None] = [None] * len(u)
    for rows in _parts(table):
        alive = rows[_greedy(u[rows], tau)]
        if len(alive) >= min_images:
            keep[alive] = True
            if place_mean and len(alive):
                means[alive[0]] = raw[alive].mean(axis=0)
    return keep, means


def worst_of(gain: np.ndarray, n: int) -> int:
    """The first image with the lowest gain; gains that differ by rounding alone are equal."""
    return int(np.argmax(gain <= gain.min() + 1e-13 * n))


def _greedy(u: np.ndarray, tau: float) -> np.ndarray:
    """Alive mask of one place after dropping worst images one by one."""
    n = len(u)
    alive = np.ones(n, dtype=bool)
    gain = u @ u.sum(axis=0) - np.einsum("ij,ij->i", u, u)
    while n > 1:
        worst = worst_of(gain, n)
        if gain[worst] / (n - 1) >= tau:
            break
        alive[worst] = False
        gain -= u @ u[worst]
        gain[~alive] = np.inf
        n -= 1
    return alive


def staged_filter(df: DataFrame, rows_per_batch: int = 512, **options) -> DataFrame:
    """:func:`coherence_filter` written once, with Arrow batches fit for wide vectors."""
    with arrow_rows(df.sparkSession, rows_per_batch):
        return stage(coherence_filter(df, **options), "coherent").df
