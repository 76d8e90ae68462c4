"""The order in which the coherence filter drops the images of a place.

Dropping the worst image again and again doesn't depend on the threshold, only its end does.  So
one pass records for each image its *step* and its *reach*, the largest worst score so far; a
threshold keeps the images whose reach is at least as large, and those never dropped.

Places that fit a task are worked off there, streamed from one shuffle.  The vectors of larger
places are written once, in blocks bucketed by place; a round reads every block where it is, takes
from it the few images that score lowest, and one task per place replays their drops as far as
what the other images can score proves them right.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocurate.functions import vectors as V
from geocurate.operators import blocks as B
from geocurate.operators import coherence as C
from geocurate.operators import places
from geocurate.runtime import new_path, stage

#: Most candidates of a round.
MAX_CANDIDATES = 16_384

_DROPS = "place_id long, image_id long, step long, reach double"


def elimination(
    df: DataFrame,
    taus: Sequence[float],
    vector: str = "embedding",
    place_means: bool = False,
    max_task_values: int = C.MAX_TASK_VALUES,
    round_candidates: int = 4096,
    manifest: DataFrame | None = None,
    width: int | None = None,
) -> DataFrame:
    """All images without their vectors, with ``step`` (1.. in order of the drops) and ``reach``.

    Both are null for images that no threshold up to the largest of *taus* drops; the order
    is recorded that far.  :func:`survivors` applies a threshold.

    With *place_means* the first survivor of a place at ``taus[i]`` carries in entry i of ``place_means`` the
    mean of the raw vectors of all survivors (null elsewhere), so no threshold needs the vectors again.

    Where *df* is a join with a store of vectors, *manifest* is its narrow side, from which the places are
    counted, and *width* the length of a vector.  Only the vectors of large places are written.
    """
    width = width or B.vector_size(df, vector)
    limit = C.task_rows(width, max_task_values)
    sizes = places.place_sizes(df if manifest is None else manifest)
    large = stage(sizes.filter(F.col("num_images") > limit).select("place_id"), "large_places").df
    if large.isEmpty():
        return _streamed(df, taus, vector, place_means)
    small = _streamed(df.join(large, "place_id", "left_anti"), taus, vector, place_means)
    rows = df.join(large, "place_id", "left_semi")
    blocks = place_blocks(rows, vector, width)
    drops = dropped(blocks, max(taus), min(round_candidates, limit), round_limit(width))
    rest = (rows if manifest is None else manifest.join(large, "place_id", "left_semi")).drop(vector)
    rest = rest.join(drops, ["place_id", "image_id"], "left")
    if place_means:
        means = block_means(blocks, drops, taus)
        rest = rest.join(means, ["place_id", "image_id"], "left")
        rest = rest.withColumn("place_means", F.coalesce("place_means", F.array_repeat(F.lit(None).cast("array<double>"), len(taus))))
    return small.unionByName(rest.select(small.columns))


def survivors(order: DataFrame, tau: float) -> DataFrame:
    """The images that the threshold *tau* leaves, of an order recorded to at least *tau*."""
    if tau <= -1:  # no mean cosine is below -1
        return order
    return order.filter(F.col("reach").isNull() | (F.col("reach") >= tau))


# -- places that fit a task ---------------------------------------------------------


def drop_order(u: np.ndarray, up_to: float) -> tuple[list[int], list[float]]:
    """Rows of one place in the order they are dropped, and the reach of each."""
    gain = u @ u.sum(axis=0) - np.einsum("ij,ij->i", u, u)
    rows, reach, n, top = [], [], len(u), -np.inf
    while n > 1:
        worst = C.worst_of(gain, n)
        top = max(top, gain[worst] / (n - 1))
        if top >= up_to:
            break
        rows.append(worst)
        reach.append(float(top))
        gain -= u @ u[worst]
        gain[rows] = np.inf
        n -= 1
    return rows, reach


def _streamed(df: DataFrame, taus: Sequence[float], vector: str, place_means: bool) -> DataFrame:
    out = [f for f in df.schema.fields if f.name != vector]
    names, up_to = [f.name for f in out], max(taus)
    added = [T.StructField("step", T.LongType()), T.StructField("reach", T.DoubleType())]
    means_type = pa.list_(pa.list_(pa.float64()))
    if place_means:
        added.append(T.StructField("place_means", T.ArrayType(T.ArrayType(T.DoubleType()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C._whole_places(batches):
            u, parts = C._units(table, vector)
            raw = C._matrix(table.column(vector), table.num_rows) if place_means else None
            step, reach = np.zeros(len(u), np.int64), np.full(len(u), np.inf)
            means: list[list] = [[None] * len(taus) for _ in range(len(u))] if place_means else []
            for rows in parts:
                order, scores = drop_order(u[rows], up_to)
                step[rows[order]], reach[rows[order]] = np.arange(1, len(order) + 1), scores
                for i, tau in enumerate(taus if place_means else ()):
                    alive = rows if tau <= -1 else rows[reach[rows] >= tau]
                    means[alive[0]][i] = raw[alive].mean(axis=0)
            done = table.select(names)
            done = done.append_column("step", pa.array(step, mask=step == 0)).append_column("reach", pa.array(reach, mask=step == 0))
            if place_means:
                done = done.append_column("place_means", pa.array(means, means_type))
            yield from done.to_batches()

    return df.repartition("place_id").sortWithinPartitions("place_id", "image_id").mapInArrow(run, T.StructType([*out, *added]))


# -- places larger than a task --------------------------------------------------------


def place_blocks(df: DataFrame, vector: str, width: int) -> B.BlockTable:
    """Vectors of large places: rows (place_id, blk, nblk, rows array<struct<id, v>>), bucketed by place and block."""
    vectors = df.select("place_id", "image_id", F.col(vector).alias("v"))
    packed = B.pack(vectors, ["place_id"], "image_id", ["v"], B.rows_per_block(width))
    return B.BlockTable.write(packed, ["place_id", "blk"], "place_blocks")


def _unit(row: dict) -> tuple[np.ndarray, np.ndarray]:
    rows = B.fields(row["rows"])
    x = B.matrix(rows, "v")
    return B.column(rows, "id"), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), C._EPS)


def round_limit(width: int) -> int:
    """Most candidates of a round: a task replays them with their vectors."""
    return min(MAX_CANDIDATES, C.task_rows(width))


def dropped(blocks: B.BlockTable, up_to: float, candidates: int, most: int = 0) -> DataFrame:
    """(place_id, image_id, step, reach) of all drops while the reach stays below *up_to*.

    The state of a round is one small row per block: the place's vector sum and size, and the ids gone from the
    block.  It comes to the blocks; no vector but the candidates' moves.  A block gives
    its lowest images and the score of the next as a barrier.  After drops that sum to D no
    other image can score below ``barrier - |D|``, so drops below that are those of the one-by-one
    procedure.  The first drop of a round always is, so every round gains.
    """
    spark = blocks.df.sparkSession
    path = new_path(spark, "dropped")
    spark.createDataFrame([], _DROPS).write.parquet(path)
    schema = pa.schema([("place_id", pa.int64()), ("total", pa.list_(pa.float64())), ("n", pa.int64())])

    def block_sum(row: dict) -> dict:
        ids, u = _unit(row)
        return {"place_id": [row["place_id"].as_py()], "total": [u.sum(axis=0)], "n": [len(ids)]}

    sums = blocks.df.select("place_id", "rows").mapInArrow(B.per_row(block_sum, schema), "place_id long, total array<double>, n long")
    place = sums.groupBy("place_id").agg(V.sum_vector(F.col("total")).alias("_s"), F.sum("n").alias("_n"))
    state = stage(
        blocks.df.select("place_id", "blk", "nblk").join(place, "place_id").select(
            "place_id", "blk", "nblk", "_s", "_n", F.lit(float("-inf")).alias("_reach"), F.lit(0).cast("long").alias("_steps"),
            F.array().cast("array<long>").alias("_gone"),
        ),
        "block_state",
    )
    while not state.df.isEmpty():
        lowest = candidates_of(blocks, state.df, candidates)
        outcome = stage(lowest.groupBy("place_id").applyInArrow(_replay(up_to), f"{_DROPS}, finished boolean, left long, lost array<double>"), "outcome")
        drops = outcome.df.filter("image_id IS NOT NULL").select("place_id", "image_id", "step", "reach")
        drops.write.mode("append").parquet(path)
        going = outcome.df.filter("image_id IS NULL AND NOT finished").select("place_id", "step", "reach", "left", "lost")
        of_block = (
            drops.join(state.df.select("place_id", "nblk").distinct(), "place_id")
            .groupBy("place_id", F.pmod(F.xxhash64("image_id"), F.col("nblk")).cast("int").alias("blk")).agg(F.collect_list("image_id").alias("_more"))
        )
        following = stage(
            state.df.join(going, "place_id").join(of_block, ["place_id", "blk"], "left").select(
                "place_id", "blk", "nblk", V.add_scaled(F.col("_s"), F.col("lost"), -1.0).alias("_s"), F.col("left").alias("_n"),
                F.col("reach").alias("_reach"), F.col("step").alias("_steps"),
                F.concat("_gone", F.coalesce("_more", F.array().cast("array<long>"))).alias("_gone"),
            ),
            "block_state",
        )
        state.drop()
        outcome.drop()
        state = following
        candidates = max(candidates, min(2 * candidates, most))
    return spark.read.schema(_DROPS).parquet(path)


def candidates_of(blocks: B.BlockTable, state: DataFrame, candidates: int) -> DataFrame:
    """The lowest images of each open block with their unit vectors, and the next score as the block's barrier."""
    names = {"image_id": pa.int64(), "gain": pa.float64(), "u": pa.list_(pa.float64()), "barrier": pa.float64()}
    carried = {"_n": pa.int64(), "_reach": pa.float64(), "_steps": pa.int64()}
    schema = pa.schema([("place_id", pa.int64()), *names.items(), *carried.items()])

    def run(row: dict) -> dict | None:
        ids, u = _unit(row)
        alive = ~np.isin(ids, row["_gone"].values.to_numpy())
        ids, u = ids[alive], u[alive]
        if not len(ids):
            return None
        gain = u @ np.array(row["_s"].values) - np.einsum("ij,ij->i", u, u)
        order = np.lexsort((ids, gain))
        few = max(1, 2 * candidates // row["nblk"].as_py())
        barrier = gain[order[few]] if len(order) > few else np.inf
        low = order[:few]
        same = lambda x: [x] * len(low)
        return {
            "place_id": same(row["place_id"].as_py()), "image_id": ids[low], "gain": gain[low], "u": list(u[low]), "barrier": same(barrier),
            **{c: same(row[c].as_py()) for c in carried},
        }

    joined = blocks.df.select("place_id", "blk", "rows").join(state, ["place_id", "blk"])
    return joined.mapInArrow(
        B.per_row(run, schema), "place_id long, image_id long, gain double, u array<double>, barrier double, _n long, _reach double, _steps long"
    )


def _replay(up_to: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("image_id").combine_chunks()  # of equal gains the smallest id falls first
        ids, gain = table.column("image_id").to_numpy(), table.column("gain").to_numpy().copy()
        u = np.array(table.column("u").combine_chunks().flatten()).reshape(len(ids), -1)
        first = {c: table.column(c)[0].as_py() for c in ("place_id", "_n", "_reach", "_steps")}
        barrier = float(np.min(table.column("barrier").to_numpy()))
        n, top, gone, reach, lost, finished = first["_n"], first["_reach"], [], [], np.zeros(u.shape[1]), False
        while n > 1 and len(gone) < len(ids):
            worst = C.worst_of(gain, n)
            if gone and gain[worst] >= barrier - np.linalg.norm(lost) - 1e-9:
                break
            if max(top, gain[worst] / (n - 1)) >= up_to:
                finished = True
                break
            top = max(top, gain[worst] / (n - 1))
            gone.append(worst)
            reach.append(top)
            lost += u[worst]
            gain -= u @ u[worst]
            gain[gone] = np.inf
            n -= 1
        finished = finished or n <= 1
        steps = first["_steps"] + np.arange(1, len(gone) + 1)
        rows = len(gone) + 1
        return pa.table(
            {
                "place_id": pa.array([first["place_id"]] * rows, pa.int64()), "image_id": pa.array([*ids[gone].tolist(), None], pa.int64()),
                "step": pa.array([*steps.tolist(), first["_steps"] + len(gone)], pa.int64()), "reach": pa.array([*reach, top], pa.float64()),
                "finished": pa.array([finished] * rows), "left": pa.array([n] * rows, pa.int64()),
                "lost": pa.array([None] * len(gone) + [lost], pa.list_(pa.float64())),
            }
        )

    return run


def block_means(blocks: B.BlockTable, drops: DataFrame, taus: Sequence[float]) -> DataFrame:
    """(place_id, image_id, place_means): on the first survivor at each threshold the mean of the raw vectors."""
    nblk = blocks.df.select("place_id", "nblk").distinct()
    gone = (
        drops.join(nblk, "place_id").groupBy("place_id", F.pmod(F.xxhash64("image_id"), F.col("nblk")).cast("int").alias("blk"))
        .agg(F.collect_list(F.struct("image_id", "reach")).alias("gone"))
    )
    none = F.array().cast("array<struct<image_id:bigint,reach:double>>")
    schema = pa.schema([("place_id", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("total", pa.list_(pa.float64()))])

    def run(row: dict) -> dict:
        rows = B.fields(row["rows"])
        ids, x = B.column(rows, "id"), B.matrix(rows, "v")
        out = row["gone"].values
        names, reach = out.field("image_id").to_numpy(), out.field("reach").to_numpy()
        parts = [x if tau <= -1 else x[~np.isin(ids, names[reach < tau])] for tau in taus]
        left = [ids if tau <= -1 else ids[~np.isin(ids, names[reach < tau])] for tau in taus]
        some = [i for i, p in enumerate(parts) if len(p)]
        return {
            "place_id": [row["place_id"].as_py()] * len(some), "at": some, "n": [len(parts[i]) for i in some],
            "first": [int(left[i].min()) for i in some], "total": [parts[i].sum(axis=0) for i in some],
        }

    joined = blocks.df.select("place_id", "blk", "rows").join(gone, ["place_id", "blk"], "left").withColumn("gone", F.coalesce("gone", none))
    sums = joined.mapInArrow(B.per_row(run, schema), "place_id long, at int, n long, first long, total array<double>")
    means = sums.groupBy("place_id", "at").agg(
        F.min("first").alias("image_id"), F.sum("n").alias("_n"), V.sum_vector(F.col("total")).alias("_s")
    ).select("place_id", "image_id", F.struct("at", F.transform("_s", lambda v: v / F.col("_n")).alias("mean")).alias("m"))
    entry = lambda i: F.get(F.transform(F.filter("ms", lambda m: m["at"] == i), lambda m: m["mean"]), F.lit(0))
    return means.groupBy("place_id", "image_id").agg(F.collect_list("m").alias("ms")).select(
        "place_id", "image_id", F.array(*[entry(i) for i in range(len(taus))]).alias("place_means")
    )
