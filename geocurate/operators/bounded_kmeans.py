"""Spherical k-means with bounds, for more centroids than a block holds or a broadcast may carry.

Angles obey the triangle inequality.  So each point has an upper bound on the angle to its own
centroid and a lower bound on the angle to all others; when centroids turn, the bounds widen by as
much, and while they don't meet the point keeps its cluster unseen.  Blocks of points lie in a
table bucketed by (group, block) and are never shuffled: labels and bounds, three numbers a
point, come to them, and so do the centroids, to blocks that hold an unsettled point only.  A
step returns the vectors that left or joined a cluster, summed per cluster and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocurate.functions import vectors as V
from geocurate.operators import blocks as B
from geocurate.runtime import Stage, arrow_rows, stage

#: Bounds that are closer than this are taken as meeting: rounding must not settle a point.
MARGIN = 1e-7

_STATE = ("label", "upper", "lower")


def cluster(packed: DataFrame, seeds: Stage, group: str, max_iter: int, rows: int, broadcast: bool) -> DataFrame:
    """Labels (id, group, cluster) of the points in *packed* blocks, from the centroids *seeds*.

    The same as Lloyd steps that compare every point with every centroid of its group, ties
    to the smaller cluster, empty clusters keeping their centroid.  Ends after *max_iter* steps, or once no label changes.
    """
    points = B.BlockTable.write(packed, [group, "blk"], "kmeans_points")
    none = lambda value: F.transform("rows", lambda r: value)
    state = stage(
        points.df.select(
            group, "blk", none(F.lit(-1).cast("long")).alias("label"), none(F.lit(float("inf"))).alias("upper"),
            none(F.lit(float("-inf"))).alias("lower"), F.lit(True).alias("open"),
        ),
        "kmeans_state",
    )
    zero = V.add_scaled(F.col("v"), F.col("v"), -1.0)
    centroids = stage(seeds.df.select(group, "cluster", "v", zero.alias("total"), F.lit(0).cast("long").alias("n")), "centroids")
    for step in range(max_iter + 1):
        with arrow_rows(points.df.sparkSession, B.BATCH_BLOCKS):
            seen = stage(_compare(points.df, state.df.filter("open"), centroids.df, group, rows, broadcast), "kmeans_step")
        settled = state.df.filter("NOT open").drop("open")
        current = settled.unionByName(seen.df.select(group, "blk", *_STATE))
        if step == max_iter or not seen.df.filter("changed > 0").limit(1).count():
            break
        following = stage(_moved(centroids.df, seen.df, group), "centroids")
        centroids.drop()
        centroids = following
        widened = stage(_widened(current, centroids.df, group), "kmeans_state")
        state.drop()
        seen.drop()
        state = widened
    names = points.df.select(group, "blk", F.col("rows.id").alias("ids")).join(current.select(group, "blk", "label"), [group, "blk"])
    out = stage(
        names.select(group, F.explode(F.arrays_zip("ids", "label")).alias("p")).select(F.col("p.ids").alias("id"), group, F.col("p.label").alias("cluster")),
        "cluster_labels",
    )
    for used in (state, seen, centroids):
        used.drop()
    points.drop()
    return out.df


def _compare(points: DataFrame, state: DataFrame, centroids: DataFrame, group: str, rows: int, broadcast: bool) -> DataFrame:
    """New labels and bounds of the open blocks, and what their points take from and bring to clusters.

    A task meets the centroid blocks of a point block one after the other and holds the best two scores of each
    unsettled point.
    """
    centre = B.pack(centroids.select(group, "cluster", "v"), [group], "cluster", ["v"], rows).select(
        group, F.col("blk").alias("cblk"), F.col("rows").alias("centre")
    )
    left = points.select(group, "blk", "rows").join(state.select(group, "blk", *_STATE), [group, "blk"])
    if broadcast:
        paired = left.join(F.broadcast(centre), group)
    else:  # the centroids go to the blocks that need them
        salts = max(8, points.sparkSession.sparkContext.defaultParallelism)
        spread = centre.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        wanted = state.select(group, "blk", F.pmod("blk", F.lit(salts)).cast("int").alias("salt")).join(spread, [group, "salt"])
        paired = left.join(wanted.drop("salt", "cblk").hint("merge"), [group, "blk"])
    moves = pa.list_(pa.struct([("cluster", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]))
    schema = pa.schema([
        (group, pa.int64()), ("blk", pa.int32()), ("label", pa.list_(pa.int64())), ("upper", pa.list_(pa.float64())),
        ("lower", pa.list_(pa.float64())), ("changed", pa.int64()), ("moves", moves),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Block | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                key = (row[group].as_py(), row["blk"].as_py())
                if held is not None and held.key != key:
                    yield held.result(schema)
                    held = None
                held = held or _Block(key, row)
                held.meet(B.fields(row["centre"]))
        if held is not None:
            yield held.result(schema)

    ddl = f"{group} long, blk int, label array<long>, upper array<double>, lower array<double>, changed long"
    return paired.select(group, "blk", "rows", *_STATE, "centre").mapInArrow(
        run, ddl + ", moves array<struct<cluster:bigint,n:bigint,total:array<double>>>"
    )


class _Block:
    """A block of points while the centroids of its group pass by."""

    def __init__(self, key: tuple[int, int], row: dict):
        self.key = key
        self.x = B.matrix(B.fields(row["rows"]), "v")
        self.label, self.upper, self.lower = (row[c].values.to_numpy().copy() for c in _STATE)
        self.unsettled = np.flatnonzero(self.upper + MARGIN >= self.lower)
        size = len(self.unsettled)
        self.best, self.second = np.full(size, -np.inf), np.full(size, -np.inf)
        self.nearest = np.full(size, np.iinfo(np.int64).max)

    def meet(self, centre: pa.StructArray) -> None:
        clusters = B.column(centre, "id")
        score = self.x[self.unsettled] @ B.matrix(centre, "v").T
        at = np.argmax(score, axis=1)  # blocks are sorted by cluster
        line = np.arange(len(score))
        top = score[line, at]
        score[line, at] = -np.inf
        rest = score.max(axis=1, initial=-np.inf)
        better = (top > self.best) | ((top == self.best) & (clusters[at] < self.nearest))
        self.second = np.maximum(np.maximum(self.second, rest), np.where(better, self.best, top))
        self.best, self.nearest = np.where(better, top, self.best), np.where(better, clusters[at], self.nearest)

    def result(self, schema: pa.Schema) -> pa.RecordBatch:
        before = self.label[self.unsettled]
        self.label[self.unsettled] = self.nearest
        angle = lambda cosine: np.arccos(np.clip(cosine, -1.0, 1.0))
        self.upper[self.unsettled] = angle(self.best)
        self.lower[self.unsettled] = np.where(np.isfinite(self.second), angle(self.second), np.inf)
        self.upper[~self.x.any(axis=1)] = np.inf  # a zero vector has no angle
        changed = np.flatnonzero(before != self.nearest)
        rows = self.x[self.unsettled[changed]]
        moves: dict[int, list] = {}
        for cluster, sign in ((before[changed], -1), (self.nearest[changed], 1)):
            for c in np.unique(cluster[cluster >= 0]).tolist():
                own = moves.setdefault(c, [0, np.zeros(self.x.shape[1])])
                own[0] += sign * int((cluster == c).sum())
                own[1] = own[1] + sign * rows[cluster == c].sum(axis=0)
        listed = [{"cluster": c, "n": n, "total": total} for c, (n, total) in moves.items()]
        values = [self.key[0], self.key[1], self.label, self.upper, self.lower, len(changed), listed]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _moved(centroids: DataFrame, seen: DataFrame, group: str) -> DataFrame:
    """Centroids after the moves, with the angle that each has turned by."""
    moves = seen.select(group, F.explode("moves").alias("m")).groupBy(group, F.col("m.cluster").alias("cluster")).agg(
        F.sum("m.n").alias("_n"), V.sum_vector(F.col("m.total")).alias("_t")
    )
    total = F.when(F.col("_t").isNull(), F.col("total")).otherwise(V.add_scaled(F.col("total"), F.col("_t"), 1.0))
    summed = centroids.join(moves, [group, "cluster"], "left").select(
        group, "cluster", "v", total.alias("total"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.col("_t").isNotNull().alias("_hit")
    )
    after = F.when(F.col("_hit") & (F.col("n") > 0), V.l2_normalize(F.col("total"))).otherwise(F.col("v"))
    turned = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("v"), F.col("_after")))))
    return summed.withColumn("_after", after).select(
        group, "cluster", F.col("_after").alias("v"), "total", "n", F.when(F.col("_hit"), turned).otherwise(F.lit(0.0)).alias("turn")
    )


def _widened(current: DataFrame, centroids: DataFrame, group: str) -> DataFrame:
    """Bounds after the centroids have turned, and whether a block holds a point whose bounds meet."""
    turns = centroids.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct("cluster", "turn"))).alias("turns"), F.max("turn").alias("most")
    )
    up: Column = F.zip_with("upper", "label", lambda u, c: u + F.try_element_at("turns", c))
    low: Column = F.transform("lower", lambda x: x - F.col("most"))
    bounds = current.join(turns, group).select(group, "blk", "label", up.alias("upper"), low.alias("lower"))
    return bounds.withColumn("open", F.exists(F.zip_with("upper", "lower", lambda u, x: u + MARGIN >= x), lambda b: b))
