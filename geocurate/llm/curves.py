"""Approximate nearest neighbours along shifted space-filling curves.

Every curve orders all vectors by the Hilbert key of a projection, shifted by an offset of its
own.  The orderings are range-partitioned and numbered in Spark; near vectors are near on
some curve.  A query is compared with the rows in a window around its place on each curve, and the
windows' best are merged by exact distance on the original vectors.  How wide windows must be
depends on the data (in isotropic noise no ordering keeps neighbours together), so the width is
measured: on a bounded sample of queries the exact neighbours are found, and the smallest width is
taken that holds the wanted share of them on one of the curves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geocurate.llm.common import release
from geocurate.operators.ids import dense_ids
from geocurate.runtime import stage

#: Dimensions of a curve's projection, and bits of each in a key.
CURVE_DIMS, KEY_BITS = 4, 15
#: Rows with the smallest hashes that scales are learned from, and queries that the width is measured on.
FIT_ROWS, TUNE_QUERIES = 20_000, 200
#: Vector entries of a block of a curve, queries compared with it at once, and pairs of them in one product.
BLOCK_VALUES, BLOCK_QUERIES, CHUNK_PAIRS = 262_144, 4096, 1 << 20
#: Standard deviations on each side of the mean that the grid covers; what lies beyond goes to its border.
SPAN = 4.0


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of *cells*, whole numbers below ``2**bits``; int64.

    Gray codes are made from the highest bit down, exchanging and inverting the lower bits of the axes as the
    curve turns; the axes' bits are then interleaved.
    """
    axes = np.ascontiguousarray(cells.T).astype(np.int64)
    for bit in range(bits - 1, 0, -1):
        lower = (1 << bit) - 1
        for axis in axes:
            turned = (axis >> bit & 1).astype(bool)
            swap = np.where(turned, 0, (axes[0] ^ axis) & lower)
            axes[0] ^= np.where(turned, lower, swap)
            axis ^= swap
    for before, axis in zip(axes, axes[1:]):
        axis ^= before
    flip = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    axes ^= flip
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | axis >> bit & 1
    return key


@dataclass(frozen=True)
class Curves:
    """Projections (one matrix for all curves side by side), centre, scales and shifts."""

    directions: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    dims: int

    @property
    def number(self) -> int:
        return self.directions.shape[1] // self.dims

    @classmethod
    def fit(cls, sample: np.ndarray, number: int, seed: int) -> Curves:
        """Random orthonormal directions, as far as the space has room for them; grids as wide as the sample."""
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(CURVE_DIMS, width)
        wanted, parts = number * dims, []
        while wanted > 0:
            take = min(wanted, width)
            parts.append(np.linalg.qr(rng.normal(size=(width, take)))[0])
            wanted -= take
        directions = np.concatenate(parts, axis=1)
        placed = sample @ directions
        scale = placed.std(axis=0)
        return cls(directions, placed.mean(axis=0), np.where(scale > 0, scale, 1.0), rng.random(number * dims), dims)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Rows x curves."""
        # a shift of up to half the box, which is twice as wide as the grid
        at = (vectors @ self.directions - self.centre) / (4 * SPAN * self.scale) + 0.25 + self.shift / 2
        cells = (np.clip(at, 0, 1 - 2.0**-KEY_BITS) * (1 << KEY_BITS)).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c * self.dims:(c + 1) * self.dims], KEY_BITS) for c in range(self.number)], axis=1)


def _rows_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def usable(vector: Column) -> Column:
    """True for vectors that aren't null or zero and have no null, NaN or infinite entry."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _classes(df: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector of *df* (id, vector, asked): its k + 2 smallest ids, and whether it is asked for.

    Of equal vectors only the smallest ids can be an answer, so any number of copies
    counts as one place on a curve.  The limit holds in each task before the shuffle.
    """
    ids = F.when(F.col("asked"), F.array(F.col("id"), F.lit(None).cast("long"))).otherwise(F.array("id"))
    order = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_first())
    return (
        df.select("vector", F.explode(ids).alias("id"))  # a null id stands for a query
        .withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= k + 2)
        .groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.max(F.col("id").isNull()).alias("asked"))
        .withColumn("point", F.monotonically_increasing_id())
    )


def _ordered(classes: DataFrame, curves: Curves, n: int) -> DataFrame:
    """*classes* with ``at``: their places 0.. on each curve.  Only keys and numbers are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = curves.keys(_rows_of(batch.column("vector")))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column("point").to_numpy(), curves.number)),
                        pa.array(np.tile(np.arange(curves.number, dtype=np.int32), len(keys))), pa.array(keys.ravel()),
                    ],
                    ["point", "curve", "key"],
                )

    keys = classes.select("point", "vector").mapInArrow(run, "point long, curve int, key long")
    numbered = dense_ids(keys, ["curve", "key", "point"], "at")
    place = lambda c: F.max(F.when(F.col("curve") == c, F.col("at") - c * n)).alias(f"at_{c}")
    places = numbered.groupBy("point").agg(*[place(c) for c in range(curves.number)])
    return classes.join(places, "point")


def _nearest_rows(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray | None, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of at least the k nearest allowed rows of each query that are no farther than *most*; ties stay."""
    squares = (rows**2).sum(1)[None] - 2 * (queries @ rows.T) + (queries**2).sum(1)[:, None]
    # the product rounds: what it is used for gets some slack, distances are taken anew
    slack = 1e-9 * ((rows**2).sum(1).max(initial=0.0) + (queries**2).sum(1))
    limit = most**2 * (1 + 1e-9) + slack
    if allowed is not None:
        squares[~allowed] = np.inf
    if rows.shape[0] > k:
        limit = np.minimum(limit, np.partition(squares, k - 1, axis=1)[:, k - 1] + 2 * slack)
    query, row = np.nonzero((squares <= limit[:, None]) & np.isfinite(squares))
    distance = np.sqrt(((queries[query] - rows[row]) ** 2).sum(axis=1))
    return query, row, distance


def _best_ids(query: np.ndarray, distance: np.ndarray, ids: pa.ListArray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest ids of each query, ties to the smaller id."""
    offsets, names = ids.offsets.to_numpy(), ids.values.to_numpy()
    size = (offsets[1:] - offsets[:-1])[row]
    start = np.repeat(offsets[:-1][row] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(row) else np.zeros(0, np.int64)
    name = names[start + np.arange(len(start))]
    query, distance = np.repeat(query, size), np.repeat(distance, size)
    order = np.lexsort((name, distance, query))
    query, name, distance = query[order], name[order], distance[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], name[keep], distance[keep]


def _exact(classes: DataFrame, sample: list, k: int) -> DataFrame:
    """Rows (asked, point) of the k nearest places of each query of a bounded sample, from all rows."""
    vectors = np.array([r["vector"] for r in sample], np.float64)
    names = np.array([r["point"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, point, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            rows, own = _rows_of(batch.column("vector")), batch.column("point").to_numpy()
            step = max(1, CHUNK_PAIRS // len(names))
            for start in range(0, len(rows), step):
                q, r, d = _nearest_rows(vectors, rows[start:start + step], None, np.full(len(names), np.inf), k)
                query, point, far = np.concatenate([query, q]), np.concatenate([point, own[start:start + step][r]]), np.concatenate([far, d])
                order = np.lexsort((point, far, query))
                query, point, far = query[order], point[order], far[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query) < k
                query, point, far = query[keep], point[keep], far[keep]
        yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(point), pa.array(far)], ["asked", "point", "distance"])

    hits = classes.select("point", "vector").mapInArrow(run, "asked long, point long, distance double")
    order = Window.partitionBy("asked").orderBy("distance", "point")
    return hits.filter("asked <> point").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") < k).select("asked", "point")


def _width(placed: DataFrame, number: int, k: int, share: float) -> int:
    """The smallest half-width whose windows hold *share* of the sampled queries' true neighbours."""
    places = [f"at_{c}" for c in range(number)]
    sample = placed.filter("asked").orderBy(F.xxhash64("vector"), "point").limit(TUNE_QUERIES).select("point", "vector", *places).collect()
    if not sample:
        return 0
    own = {r["point"]: np.array([r[p] for p in places]) for r in sample}
    near = _exact(placed, sample, k + 1).join(placed.select("point", *places), "point").collect()
    gaps = sorted(int(np.abs(own[r["asked"]] - np.array([r[p] for p in places])).min()) for r in near)
    return gaps[min(len(gaps) - 1, math.ceil(share * len(gaps)))] if gaps else 0


def _windows(placed: DataFrame, best: DataFrame | None, curve: int, width: int, block: int, n: int, asked: int, k: int) -> DataFrame:
    """(point, id, distance) of the best rows in the queries' windows on one curve.

    Points are dealt by blocks of the curve, queries by runs of it with at most
    `BLOCK_QUERIES` in a group; a group meets the blocks that its windows reach into, each in a task of its own.
    """
    at = F.col(f"at_{curve}")
    run = block * max(1, n // max(1, asked))
    queries = placed.filter("asked").select("point", "vector", at.alias("at"), F.floor(at / run).alias("run"))
    if best is None:
        queries = queries.withColumn("most", F.lit(math.inf))
    else:
        last = best.filter(F.col("rank") == k).select("point", F.col("distance").alias("most"))
        queries = queries.join(last, "point", "left").fillna(math.inf, ["most"])
    runs = stage(
        placed.filter("asked").groupBy(F.floor(at / run).alias("run"))
        .agg(F.min(at).alias("low"), F.max(at).alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("parts")),
        "runs",
    ).df
    blocks = F.sequence(F.floor(F.greatest(F.col("low") - width, F.lit(0)) / block), F.floor(F.least(F.col("high") + width, F.lit(n - 1)) / block))
    pairs = runs.select("run", "parts", F.explode(blocks).alias("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = (
        placed.filter(F.size("ids") > 0).select("ids", F.col("vector").alias("row"), at.alias("at"), F.floor(at / block).alias("block"))
        .join(pairs.select("run", "part", "block"), "block").groupBy("run", "part", "block")
    )
    part = F.pmod(F.xxhash64("point"), F.col("parts")).alias("part")
    right = (
        queries.join(runs.select("run", "parts"), "run").select("point", "vector", "at", "most", "run", part)
        .join(pairs.select("run", "part", "block"), ["run", "part"]).groupBy("run", "part", "block")
    )

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asked.num_rows:
            x, place = _rows_of(rows.column("row").combine_chunks()), rows.column("at").to_numpy()
            ids = rows.column("ids").combine_chunks()
            ids = ids if isinstance(ids, pa.ListArray) else ids.cast(pa.list_(pa.int64()))
            q, own = _rows_of(asked.column("vector").combine_chunks()), asked.column("at").to_numpy()
            most, name = asked.column("most").to_numpy(), asked.column("point").to_numpy()
            step = max(1, CHUNK_PAIRS // len(x))
            for start in range(0, len(q), step):
                some = slice(start, start + step)
                allowed = np.abs(place[None] - own[some, None]) <= width
                query, row, distance = _nearest_rows(q[some], x, allowed, most[some], k)
                query, identity, distance = _best_ids(query, distance, ids, row, k)
                found.append((name[some][query], identity, distance))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], ["point", "id", "distance"])

    return left.cogroup(right).applyInArrow(compare, "point long, id long, distance double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("point").orderBy("distance", "id")
    once = found.dropDuplicates(["point", "id"])
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    curves: int = 8, share: float = 0.95, seed: int = 1,
) -> DataFrame:
    """The k nearest rows found for each row of *df* that *is_query* holds for: (query_id, rank, id, distance).

    Candidates are all rows but those with the query's own id; distance is Euclidean, in double precision, on the
    original vectors; ties go to the smaller id.  *share* is the recall that the width of the windows is
    measured to reach on a sample of at most `TUNE_QUERIES` queries.

    Vectors that are null, zero, empty or hold null or non-finite entries take no part, neither do rows without an
    id; vectors of unlike length are an error.  Rows that repeat both id and vector count once; where an id comes
    with several vectors, each asks and is found by itself.  With fewer candidates than k all are returned.  Equal vectors
    share one place on the curves.  Other columns are not read, so they may have any name.

    The curves are searched one after the other, so the vectors lie in one table and in one shuffle at a time;
    the k-th best so far bounds what the next curve returns.
    """
    spark = df.sparkSession
    rows = stage(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
        .filter(usable(F.col("vector")) & F.col("id").isNotNull()),
        "vectors",
    ).df
    sizes = rows.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if sizes["low"] != sizes["high"]:
        raise ValueError(f"vectors of {sizes['low']} to {sizes['high']} entries")
    classes = stage(_classes(rows, k), "distinct_vectors").df
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    sample = classes.orderBy(F.xxhash64("vector"), "point").limit(FIT_ROWS).select("vector").toArrow()
    fitted = Curves.fit(_rows_of(sample.column("vector").combine_chunks()), curves, seed)
    placed = stage(_ordered(classes, fitted, n), "placed_vectors").df
    asked = placed.filter("asked").count()
    width = _width(placed, curves, k, share)
    block = max(1, BLOCK_VALUES // sizes["high"])
    best = None
    for curve in range(curves):
        found = _windows(placed, best, curve, width, block, n, asked, k + 1)
        if best is not None:
            found = found.unionByName(best.select("point", "id", "distance"))
        best = stage(_merged(found, k + 1), "nearest").df
        release(spark)
    # equal queries share their answers, but for themselves
    queries = rows.filter("asked").select(F.col("id").alias("query_id"), "vector").distinct()
    queries = queries.join(placed.filter("asked").select("point", "vector"), "vector").drop("vector")
    order = Window.partitionBy("query_id", "point").orderBy("distance", "id")
    return (
        queries.join(best.drop("rank"), "point").filter(F.col("id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )
