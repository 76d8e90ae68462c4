"""Supergroups: spatially separated outer groups, clustered by place embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geocurate.functions import geo
from geocurate.functions import vectors as V
from geocurate.operators import blocks as B
from geocurate.operators import bounded_kmeans, checks, places
from geocurate.operators.ids import rank_in_group, sample_hash
from geocurate.runtime import Stage, arrow_rows, stage

#: Centroids are broadcast while all of them together stay below this many bytes.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def outer_groups(place_cells: DataFrame, spatial: int = 5, angular: int = 2) -> DataFrame:
    cell_h = F.col("cell_h") if "cell_h" in place_cells.columns else None
    return place_cells.withColumn(
        "outer_group", geo.outer_group(F.col("cell_x"), F.col("cell_y"), cell_h, spatial, angular)
    )


def allocate_k(place_groups: DataFrame, size: int) -> DataFrame:
    """Clusters per outer group, in proportion to its places.

    ``total = max(1, n // size)`` clusters are shared out, halves rounded to even,
    at least one and at most as many as the group has places.  ``first`` is the
    number of the group's first cluster.  There are at most spatial^2 * angular
    groups, so the window over this table is small by construction.
    """
    sizes = place_groups.groupBy("outer_group").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    share = F.bround(F.col("n") / total * F.greatest(F.lit(1), F.floor(total / F.lit(size))))
    k = F.least(F.col("n"), F.greatest(F.lit(1), share)).cast("long")
    before = everything.orderBy("outer_group").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("k", k)
        .withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)).cast("long"))
    )


def assign_supergroups(
    images: DataFrame,
    place_vectors: DataFrame,
    size: int = 64,
    spatial: int = 5,
    angular: int = 2,
    max_iter: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Add ``supergroup_id`` to every image.

    Clusters are numbered by ascending outer group, then by cluster.
    """
    table = stage(
        outer_groups(places.cells_of_places(images), spatial, angular), "place_groups"
    ).df
    checks.require_keys(table, place_vectors, ["place_id"], "place_ids")
    share = stage(allocate_k(table, size), "cluster_share").df
    points = table.select("place_id", "outer_group").join(
        place_vectors.select("place_id", "embedding"), "place_id"
    )
    labels = spherical_kmeans(points, share, max_iter, seed)
    groups = labels.join(F.broadcast(share.select("outer_group", "first")), "outer_group").select(
        "place_id", (F.col("first") + F.col("cluster")).alias("supergroup_id")
    )
    return images.drop("supergroup_id").join(groups, "place_id")


def spherical_kmeans(
    points: DataFrame,
    share: DataFrame,
    max_iter: int = 100,
    seed: int = 42,
    id_col: str = "place_id",
    group_col: str = "outer_group",
    vector: str = "embedding",
    rows: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Cluster the unit vectors of every group at once: (id, group, cluster).

    Lloyd steps with renormalised centroids; the nearest centroid has the largest
    inner product, ties going to the smaller cluster.  The first centroids are the k
    members with the smallest hash.  An empty cluster keeps its centroid.  The loop
    ends early once no point changes its cluster.

    Points are packed once into blocks.  While the centroids can be broadcast and those of a group fit a
    block, a step returns partial sums per cluster and block, and a digest of the members by which unchanged
    labels are seen.  Beyond that size :mod:`bounded_kmeans` leaves the blocks where they are and
    compares only the points whose bounds don't settle their cluster.
    """
    spark = points.sparkSession
    unit = stage(
        points.select(id_col, group_col, V.l2_normalize(F.col(vector), 1e-8).alias("v")), "unit_points"
    )
    share = stage(share.select(group_col, "k"), "share").df
    dim = B.vector_size(unit.df, "v")
    rows = rows or B.rows_per_block(dim)
    bounds = share.agg(F.max("k").alias("top"), F.sum("k").alias("total")).first()
    broadcast = (bounds["total"] or 0) * dim * 8 <= max_broadcast_bytes
    one_block = (bounds["top"] or 0) <= rows
    packed = B.pack(unit.df, [group_col], id_col, ["v"], rows)

    ranked = rank_in_group(
        unit.df.select(id_col, group_col).withColumn("_h", sample_hash(seed, id_col)),
        [group_col], ["_h", id_col], "cluster",
    )
    seeds = ranked.join(F.broadcast(share.select(group_col, "k")), group_col).filter(
        F.col("cluster") < F.col("k")
    )
    centroids = stage(
        seeds.select(id_col, group_col, "cluster").join(unit.df.select(id_col, "v"), id_col)
        .select(group_col, "cluster", "v"),
        "centroids",
    )
    if not (broadcast and one_block):
        labels = bounded_kmeans.cluster(packed, centroids, group_col, max_iter, rows, broadcast)
        unit.drop()
        return labels.withColumnRenamed("id", id_col)
    packed = stage(packed, "point_blocks")
    unit.drop()

    def paired(current: DataFrame) -> DataFrame:
        centre = B.pack(current.select(group_col, "cluster", "v"), [group_col], "cluster", ["v"], rows, True)
        left = packed.df.select(group_col, "blk", F.col("rows").alias("left"))
        return left.join(F.broadcast(centre.select(group_col, F.col("rows").alias("right"))), group_col)

    centroids = Stage(centroids.df.withColumns({"n": F.lit(0).cast("long"), "digest": F.lit(0).cast("long")}), centroids.path)
    for _ in range(max_iter):
        sums = paired(centroids.df).select(group_col, "left", "right").mapInArrow(
            B.per_row(_partial_sums(group_col), _sums_schema(group_col)), _sums_ddl(group_col)
        )
        moved = sums.groupBy(group_col, "cluster").agg(
            V.sum_vector(F.col("total")).alias("_sum"), F.sum("n").alias("_n"), F.bit_xor("digest").alias("_digest")
        )
        members = {"n": F.coalesce("_n", F.lit(0)), "digest": F.coalesce("_digest", F.lit(0))}
        following = centroids.df.join(moved, [group_col, "cluster"], "left").select(
            group_col,
            "cluster",
            F.coalesce(V.l2_normalize(F.col("_sum")), F.col("v")).alias("v"),
            *[c.alias(name) for name, c in members.items()],
            ((F.col("n") != members["n"]) | (F.col("digest") != members["digest"])).alias("changed"),
        )
        with arrow_rows(spark, B.BATCH_BLOCKS):
            step = stage(following, "centroids")
        changed = step.df.filter("changed").limit(1).count()
        centroids.drop()
        centroids = step
        if not changed:
            break
    nearest = paired(centroids.df).select(group_col, "blk", "left", "right").mapInArrow(
        B.per_row(_nearest(group_col), _nearest_schema(group_col)), _nearest_ddl(group_col)
    )
    with arrow_rows(spark, B.BATCH_BLOCKS):
        labels = stage(nearest.select("id", group_col, "cluster"), "cluster_labels")
    packed.drop()
    centroids.drop()
    return labels.df.withColumnRenamed("id", id_col)


def _sums_schema(group_col: str) -> pa.Schema:
    return pa.schema(
        [
            (group_col, pa.int64()), ("cluster", pa.int64()), ("total", pa.list_(pa.float64())),
            ("n", pa.int64()), ("digest", pa.int64()),
        ]
    )


def _nearest_schema(group_col: str) -> pa.Schema:
    return pa.schema(
        [(group_col, pa.int64()), ("id", pa.int64()), ("cluster", pa.int64()), ("score", pa.float64())]
    )


def _sums_ddl(group_col: str) -> str:
    return f"{group_col} long, cluster long, total array<double>, n long, digest long"


def _nearest_ddl(group_col: str) -> str:
    return f"{group_col} long, id long, cluster long, score double"


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    left, right = B.fields(row["left"]), B.fields(row["right"])
    x, c = B.matrix(left, "v"), B.matrix(right, "v")
    score = x @ c.T
    return B.column(left, "id"), x, B.column(right, "id"), score


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Hashes whose exclusive or tells sets of ids apart."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _partial_sums(group_col: str):
    def run(row: dict) -> dict:
        ids, x, clusters, score = _scores(row)
        label = np.argmax(score, axis=1)
        member = np.zeros((len(clusters), len(x)))
        member[label, np.arange(len(x))] = 1.0
        used = np.unique(label)
        total = (member @ x)[used]
        hashes = _mixed(ids)
        digest = [int(np.bitwise_xor.reduce(hashes[label == c])) for c in used]
        return {
            group_col: np.full(len(used), row[group_col].as_py()),
            "cluster": clusters[used],
            "total": list(total),
            "n": np.bincount(label)[used],
            "digest": digest,
        }

    return run


def _nearest(group_col: str):
    def run(row: dict) -> dict:
        ids, x, clusters, score = _scores(row)
        label = np.argmax(score, axis=1)
        return {
            group_col: np.full(len(ids), row[group_col].as_py()),
            "id": ids,
            "cluster": clusters[label],
            "score": score[np.arange(len(x)), label],
        }

    return run
