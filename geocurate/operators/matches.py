"""Ground truth of an evaluation set: database images near each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from geocurate.operators import tiles
from geocurate.runtime import TASK_BYTES, stage

#: Rows of either side of a cell that meet in one task, and bytes of one there, about.
CELL_ROWS = 1 << 18
_ROW_BYTES = 96
#: Length of a cell in radii, and strips a radius that a task cuts it into where they hold rows enough.
CELL_RADII = 8
STRIPS_PER_RADIUS = 4
STRIP_ROWS = 256
#: Distances that are taken in one step.
STEP_PAIRS = 1 << 16


class _Cell:
    """Database rows of a cell, in strips of neighbouring eastings, each in the order of its northings."""

    def __init__(self, rows: pa.RecordBatch, radius_m: float):
        e, n = (rows.column(c).to_numpy() for c in ("e", "n"))
        width = e.max() - e.min()
        strips = max(1, len(e) // STRIP_ROWS)
        if radius_m > 0:
            strips = int(min(strips, max(1.0, np.ceil(STRIPS_PER_RADIUS * (width / radius_m)))))
        strip = np.minimum(((e - e.min()) * (strips / width)).astype(np.int64), strips - 1) if strips > 1 and width > 0 else np.zeros(len(e), np.int64)
        order = np.lexsort((n, strip))
        self.ids, self.e, self.n = rows.column("id").take(pa.array(order)), e[order], n[order]
        edges = [0, *(np.flatnonzero(np.diff(strip[order])) + 1).tolist(), len(e)]
        self.strips = [(a, b, self.e[a:b].min(), self.e[a:b].max()) for a, b in zip(edges, edges[1:])]
        self.limit, self.reach = radius_m ** 2, radius_m * (1 + 1e-9)

    def near(self, qe: np.ndarray, qn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of queries, how many rows are within the radius of each, and the positions of those."""
        for a, b, low, high in self.strips:
            gap = np.maximum(np.maximum(low - qe, qe - high), 0.0)
            q = np.flatnonzero(gap <= self.reach)
            chord = np.sqrt(self.reach ** 2 - gap[q] ** 2)  # a strip is met only as far as the circle reaches
            first = a + np.searchsorted(self.n[a:b], qn[q] - chord, "left")
            count = a + np.searchsorted(self.n[a:b], qn[q] + chord, "right") - first
            ends = np.cumsum(count)
            at = 0
            while at < len(q):  # about STEP_PAIRS distances at a time
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + STEP_PAIRS, "right")))
                own, c, last = q[at:to], count[at:to], ends[at:to] - done
                right = np.arange(last[-1]) + np.repeat(first[at:to] - (last - c), c)
                de, dn = np.repeat(qe[own], c) - self.e[right], np.repeat(qn[own], c) - self.n[right]
                hit = np.flatnonzero(de * de + dn * dn <= self.limit)
                hits = np.diff(np.searchsorted(hit, last, "left"), prepend=0)
                yield own[hits > 0], hits[hits > 0], right[hit]
                at = to


def radius_pairs(images: DataFrame, radius_m: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, database_id) within *radius_m* metres, the limit included.

    Positions are written once and hashed to cells of CELL_RADII radii.  A query looks into the cells
    that its circle reaches, four at most, and cells without database images or queries are dropped.  A task
    holds the database images of a cell while its queries stream past.  A crowded cell is cut into fragments of about
    *cell_rows* rows on either side, and each query fragment meets each database fragment under its own key:
    rows are copied only where each copy meets that many others, so that copies stay a small share of the pairs.
    """
    reach = radius_m * (1 + 1e-9)
    size = CELL_RADII * radius_m or 1.0
    finite = [F.abs(F.col(c)) < F.lit(float("inf")) for c in ("utm_east", "utm_north")]
    spots = stage(
        images.filter(finite[0] & finite[1]).select("image_id", "is_query", "utm_east", "utm_north"), "spots"
    ).df.select("is_query", F.col("image_id").alias("id"), F.col("utm_east").cast("double").alias("e"), F.col("utm_north").cast("double").alias("n"))

    def reached(axis: str):
        """The one or two cells that the circle reaches along an axis."""
        return F.explode(F.array_distinct(F.array(*[F.floor((F.col(axis) + d) / size) for d in (-reach, reach)])))

    queries = spots.filter("is_query").withColumn("cx", reached("e")).withColumn("cy", reached("n"))
    database = spots.filter("not is_query").withColumn("cx", F.floor(F.col("e") / size)).withColumn("cy", F.floor(F.col("n") / size))

    def fragments(n: str):
        return F.ceil(F.col(n) / F.lit(cell_rows)).cast("int")

    cells = stage(
        database.groupBy("cx", "cy").agg(F.count("*").alias("nd"))
        .join(queries.groupBy("cx", "cy").agg(F.count("*").alias("nq")), ["cx", "cy"])
        .select("cx", "cy", "nd", "nq", fragments("nd").alias("fd"), fragments("nq").alias("fq")),
        "cells",
    ).df

    def side(rows: DataFrame, number: int, own: str, other: str) -> DataFrame:
        """Rows of a side, each in its fragment and before every fragment of the other side."""
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        cut = rows.join(cells.select("cx", "cy", "fd", "fq"), ["cx", "cy"]).select("*", mine.alias(f"_{own}"), met.alias(f"_{other}"))
        return cut.select("cx", "cy", (F.col("_fd") * F.col("fq") + F.col("_fq")).alias("_part"), F.lit(number).alias("_side"), "id", "e", "n")

    moved = cells.agg(F.sum(F.col("nd") * F.col("fq") + F.col("nq") * F.col("fd"))).first()[0] or 0
    spark = images.sparkSession
    # as many tasks as the cluster has room for, and no more rows in each than it can sort
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-moved * _ROW_BYTES // TASK_BYTES))
    both = side(database, 0, "fd", "fq").unionByName(side(queries, 1, "fq", "fd"))
    key = ("cx", "cy", "_part")
    ordered = both.repartition(tasks, *key).sortWithinPartitions(*key, "_side")
    id_type = spots.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, cell = None, [], None
        for batch in batches:
            for mine, number, piece in tiles.runs(batch, (*key, "_side")):
                if mine != at:
                    at, pieces, cell = mine, [], None
                if number == 0:
                    pieces.append(piece)
                    continue
                if cell is None:
                    if not pieces:
                        continue  # a fragment that no row is dealt to
                    cell, pieces = _Cell(pa.Table.from_batches(pieces).combine_chunks().to_batches()[0], radius_m), []
                ids = piece.column("id")
                for own, hits, right in _joined(cell.near(piece.column("e").to_numpy(), piece.column("n").to_numpy())):
                    offsets = pa.array(np.concatenate([[0], np.cumsum(hits)]), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, cell.ids.take(pa.array(right)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), lists], ["query_id", "database_ids"])

    # lists leave Python sooner than pairs; they are short, as they hold a strip's part of a circle at most
    found = ordered.mapInArrow(run, StructType([StructField("query_id", id_type), StructField("database_ids", ArrayType(id_type))]))
    return found.select("query_id", F.explode("database_ids").alias("database_id"))


def _joined(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Few large steps for many small ones."""
    kept, n = [], 0
    for step in found:
        kept.append(step)
        n += len(step[2])
        if n >= STEP_PAIRS:
            yield tuple(map(np.concatenate, zip(*kept)))
            kept, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*kept)))


def add_matches(images: DataFrame, radius_m: float) -> DataFrame:
    """Add ``matches`` (ascending ids) to the queries; drop queries without any.

    Database rows keep null.  The list form is the stored form of an evaluation set;
    statistics and recall work on :func:`radius_pairs` and never build lists.
    """
    lists = (
        radius_pairs(images, radius_m)
        .groupBy(F.col("query_id").alias("image_id"))
        .agg(F.array_sort(F.collect_list("database_id")).alias("matches"))
    )
    return images.drop("matches").join(lists, "image_id", "left").filter(
        ~F.col("is_query") | F.col("matches").isNotNull()
    )


def gold_pairs(images: DataFrame) -> DataFrame:
    """(query_id, database_id) of a stored evaluation set, limited to database rows."""
    database = images.filter("not is_query").select(F.col("image_id").alias("database_id"))
    return (
        images.filter("is_query")
        .select(F.col("image_id").alias("query_id"), F.explode("matches").alias("database_id"))
        .join(database, "database_id", "left_semi")
        .select("query_id", "database_id")
    )


def ground_truth(images: DataFrame) -> DataFrame:
    """Every query with the sorted database ids it should find (empty if none)."""
    lists = gold_pairs(images).groupBy(F.col("query_id").alias("image_id")).agg(
        F.array_sort(F.collect_list("database_id")).alias("gold")
    )
    return (
        images.filter("is_query").select("image_id").join(lists, "image_id", "left")
        .withColumn("gold", F.coalesce("gold", F.array().cast("array<long>")))
    )
