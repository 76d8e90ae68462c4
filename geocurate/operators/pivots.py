"""Exact nearest neighbours from blocks around pivots.

Database rows are dealt to the pivot of largest cosine, and by their angle to it into shells; the
blocks of a shell are stored once.  Query rows are blocked the same way.  By the triangle inequality of
angles two blocks hold no pair closer than the angle between their centres less both covering angles.

A task holds a part of the database's blocks, up to a fixed number of rows, while query blocks stream past.  It
compares each with the blocks nearest to it; the k-th best there is a bound, and what else it compares
are the blocks that can hold something as good.  Neither pairs of blocks nor blocks for each pair are
ever rows of a table: a query goes once to each part, and a part once to each split of the queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geocurate.operators import blocks as B
from geocurate.operators import tiles
from geocurate.operators.ids import sample_hash
from geocurate.runtime import arrow_rows, stage

#: Pivots are sent to the tasks up to this size.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: Most shells around a pivot; a shell that is larger than a block has several.
SHELLS = 64
#: Blocks that a query block meets first, at least.
PROBES = 2
#: Angles closer than this count as equal: the arc cosine of a rounded product is no better.
MARGIN = 1e-7
#: Query rows that are compared at once.
ASKED_ROWS = 256
#: Rows of a part whose largest score is looked at as one, and pairs whose scores are made in double precision at once.
GROUP, EXACT_ROWS = 16, 1 << 16
#: Rows of the database that a task holds, of any number, and rows of a split of the queries.
PART_ROWS = 16_384

_BLOCK = ("pivot", "shell", "blk")


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


@dataclass
class Blocks:
    """Stored blocks (number, rows array<struct<id, v>>) and their summaries (number, centre, cover, n)."""

    table: B.BlockTable
    summary: DataFrame

    def drop(self) -> None:
        self.table.drop()


@dataclass
class Index:
    """Blocks of a database with the pivots they lie around; serves any number of searches."""

    blocks: Blocks
    pivots: np.ndarray
    rows: int


def build(database: DataFrame, vector: str = "embedding", id_col: str = "image_id", rows: int | None = None, seed: int = 42) -> Index:
    """Index all rows.  The pivots are the rows with the smallest hashes, one per block as far as a broadcast holds them."""
    width = max(1, B.vector_size(database, vector))
    rows = rows or B.rows_per_block(width)
    most = max(1, min(-(-database.count() // rows), MAX_BROADCAST_BYTES // (8 * width)))
    chosen = database.select(F.col(id_col), F.col(vector).alias("v")).orderBy(sample_hash(seed, id_col), id_col).limit(most).toArrow()
    pivots = B.unit_rows(np.array(chosen.column("v").combine_chunks().flatten(), np.float64).reshape(chosen.num_rows, -1))
    return Index(_blocked(database, pivots, vector, id_col, rows, "pivot_blocks"), pivots, rows)


def _covering(u: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of the unit vectors of a block, and the angle that covers them."""
    total = u.sum(axis=0)
    centre = total / np.linalg.norm(total) if np.linalg.norm(total) > 1e-6 else u[0]
    # a zero vector, or a zero centre, is at no angle: such a block is never left out
    whole = u.any(axis=1).all() and centre.any()
    return centre, float(_angle(u @ centre).max()) if whole else math.pi


def _blocked(df: DataFrame, pivots: np.ndarray, vector: str, id_col: str, rows: int, label: str) -> Blocks:
    sent = df.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
            pivot, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            step = max(1, 8 * tiles.TILE_CELLS // max(1, len(sent.value)))
            for low in range(0, len(x), step):
                score = B.unit_rows(x[low:low + step]) @ sent.value.T
                best = score.argmax(axis=1)
                pivot[low:low + step], far[low:low + step] = best, _angle(score[np.arange(len(score)), best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(far)], ["id", "v", "pivot", "far"])

    near = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        assign, "id long, v array<double>, pivot int, far double"
    )
    near = stage(near, "assigned").df
    cuts = [i / SHELLS for i in range(1, SHELLS)]
    around = near.groupBy("pivot").agg(
        F.least(F.lit(SHELLS), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("shells"), F.percentile_approx("far", cuts).alias("cuts")
    )
    around = stage(around, "pivot_shells").df
    # the quantile of the row, in as many steps as the pivot has shells
    quantile = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    shelled = near.join(around, "pivot").withColumn("shell", F.floor(quantile * F.col("shells") / SHELLS).cast("int"))
    packed = B.pack(shelled.select("id", "v", "pivot", "shell"), ["pivot", "shell"], "id", ["v"], rows)
    number = F.xxhash64(*_BLOCK).alias("number")
    table = B.BlockTable.write(packed.select(number, "rows"), ["number"], label)
    schema = pa.schema([("number", pa.int64()), ("centre", pa.list_(pa.float64())), ("cover", pa.float64()), ("n", pa.int64())])

    def summarise(row: dict) -> dict:
        u = B.unit_rows(B.matrix(B.fields(row["rows"]), "v"))
        centre, cover = _covering(u)
        return {"number": [row["number"].as_py()], "centre": [centre], "cover": [cover], "n": [len(u)]}

    summary = stage(
        table.df.select("number", "rows").mapInArrow(B.per_row(summarise, schema), "number long, centre array<double>, cover double, n long"),
        "block_summary",
    )
    return Blocks(table, summary.df)


def search(index: Index, queries: DataFrame, k: int, vector: str = "embedding", id_col: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """The k database rows of largest cosine per query, ties to the smaller id, as :func:`retrieval.knn` gives them.

    Also returns one row (pairs, compared): pairs of a query block and a database block there are, and
    those whose rows were compared.
    """
    spark = queries.sparkSession
    asked = _blocked(queries, index.pivots, vector, id_col, index.rows, "query_blocks")
    width = index.pivots.shape[1] if index.pivots.ndim == 2 else 1
    held = max(1, min(PART_ROWS, tiles.HELD_VALUES // max(1, width)))
    total = {name: side.summary.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
             for name, side in (("asked", asked), ("blocks", index.blocks))}
    parts, splits = (max(1, -(-total[name]["rows"] // held)) for name in ("blocks", "asked"))
    with arrow_rows(spark, max(B.BATCH_BLOCKS, B.BATCH_BLOCKS * B.rows_per_block(width) // index.rows)):
        found = stage(_compared(asked, index.blocks, parts, splits, k), "hits").df
    out = stage(_ranked(found.filter("compared IS NULL").drop("compared"), k), "neighbours").df
    pairs = total["asked"]["blocks"] * total["blocks"]["blocks"]
    report = found.agg(F.lit(pairs).cast("long").alias("pairs"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    report = stage(report, "pruning").df
    asked.drop()
    return out, report


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("database_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


class _Side:
    """Blocks of a record batch, or of several: ids and unit vectors of their rows, block after block."""

    def __init__(self, pieces: list[pa.RecordBatch]):
        lists = pa.concat_arrays([p.column("rows") for p in pieces])
        rows = lists.flatten()
        self.ids, self.u = B.column(rows, "id"), B.unit_rows(B.matrix(rows, "v"))
        self.short = self.u.astype(np.float32)
        self.ends = np.cumsum(lists.value_lengths().to_numpy())
        self.starts = np.concatenate([[0], self.ends[:-1]])
        covers = [_covering(self.u[a:b]) for a, b in zip(self.starts, self.ends)]
        self.centre, self.cover = np.stack([c for c, _ in covers]), np.array([c for _, c in covers])

    def rows_of(self, chosen: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.repeat(chosen, self.ends - self.starts))


def _best(asked: np.ndarray, part: _Side, chosen: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query row, row of the part and score of the k best of each query, with all that tie with the last; and what the last's score reaches.

    *chosen* are the rows of the part that count.  A product in single precision, whose error is bounded, finds
    the rows that can be among the best; only theirs are the scores in double precision.
    """
    short = part.short if chosen is None else part.short[chosen]
    score = asked.astype(np.float32) @ short.T
    error = (asked.shape[1] + 8) * 2.0**-24  # of unit vectors, with both roundings
    n = score.shape[1]
    if n < k:
        floor = np.full(len(score), -2.0, np.float32)
    else:
        # k groups of rows have a maximum that reaches the k-th largest one, so k rows do
        width = n // GROUP if n // GROUP >= 8 * k else n
        heads = score if width == n else score[:, :width].copy()
        for i in range(1, GROUP if width < n else 1):
            np.maximum(heads, score[:, i * width:(i + 1) * width], out=heads)
        floor = np.partition(heads, width - k, axis=1)[:, width - k]
    q, d = np.divmod(np.flatnonzero(score >= (floor - np.float32(3 * error))[:, None]), max(1, n))
    d = d if chosen is None else chosen[d]
    exact = np.empty(len(q))
    for low in range(0, len(q), EXACT_ROWS):
        own = slice(low, low + EXACT_ROWS)
        exact[own] = np.einsum("ij,ij->i", asked[q[own]], part.u[d[own]])
    return q, d, exact, floor.astype(np.float64) - error


def _meet(asked: _Side, low: int, high: int, part: _Side, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Hits of the query blocks *low* to *high* in a part: query ids, database ids, scores, blocks compared."""
    far = _angle(asked.centre[low:high] @ part.centre.T)
    most = min(far.shape[1], PROBES + k)  # no block is empty
    sizes = part.ends - part.starts
    masks, cells = [], 0
    for at in range(low, high):
        line = far[at - low]
        first = np.argpartition(line, most - 1)[:most]
        first = first[np.argsort(line[first], kind="stable")]
        first = first[:max(PROBES, int(np.searchsorted(np.cumsum(sizes[first]), k)) + 1)]
        probed = np.zeros(len(line), bool)
        probed[first] = True
        own = asked.u[asked.starts[at]:asked.ends[at]]
        near = part.rows_of(probed)
        limits = [_best(own[a:a + ASKED_ROWS], part, near, k)[3].min() for a in range(0, len(own), ASKED_ROWS)]
        limit = min(limits)
        reach = math.pi if limit < -1.5 else float(_angle(np.array(limit)))
        mask = probed | (line - part.cover - asked.cover[at] <= reach + MARGIN)
        masks.append(mask)
        cells += len(own) * int(sizes[mask].sum())
    rows = slice(asked.starts[low], asked.ends[high - 1])
    if 2 * cells >= (rows.stop - rows.start) * len(part.u):  # little can be left out: one product for all
        work = [(rows, None, (high - low) * far.shape[1])]
    else:
        work = [(slice(asked.starts[at], asked.ends[at]), part.rows_of(mask), int(mask.sum())) for at, mask in zip(range(low, high), masks)]
    for own, chosen, compared in work:
        for a in range(own.start, own.stop, ASKED_ROWS):
            b = min(a + ASKED_ROWS, own.stop)
            q, d, score, _ = _best(asked.u[a:b], part, chosen, k)
            order = np.lexsort((part.ids[d], -score, q))  # of copies that tie, only those with the smallest ids
            q, d, score = q[order], d[order], score[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield asked.ids[a:b][q[kept]], part.ids[d[kept]], score[kept], compared if a == own.start else 0


def _compared(asked: Blocks, blocks: Blocks, parts: int, splits: int, k: int) -> DataFrame:
    """(query_id, database_id, score, compared): every query's k best rows of each part; and rows with only the number of pairs compared."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod("number", F.lit(n)).cast("int")
    left = blocks.table.df.select(own(parts).alias("part"), each(splits).alias("split"), F.lit(0).alias("side"), "number", "rows")
    right = asked.table.df.select(each(parts).alias("part"), own(splits).alias("split"), F.lit(1).alias("side"), "number", "rows")
    spark = asked.table.df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    both = left.unionByName(right).repartition(tasks, "part", "split").sortWithinPartitions("part", "split", "side", "number")
    schema = pa.schema([("query_id", pa.int64()), ("database_id", pa.int64()), ("score", pa.float64()), ("compared", pa.int64())])

    def table(q, d, score, compared) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(q), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(score, pa.float64()), none], schema=schema)
        if compared:
            yield pa.RecordBatch.from_pylist([{"compared": compared}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, part = None, [], None
        for batch in batches:
            for mine, side, piece in tiles.runs(batch, ("part", "split", "side")):
                if mine != key:
                    key, pieces, part = mine, [], None
                if side == 0:
                    pieces.append(piece)
                    continue
                if part is None:
                    if not pieces:
                        continue  # a part that no block is dealt to
                    part, pieces = _Side(pieces), []
                query = _Side([piece])
                low = 0
                while low < len(query.ends):  # blocks of about ASKED_ROWS rows at once
                    high = max(low + 1, int(np.searchsorted(query.ends, query.starts[low] + ASKED_ROWS, side="right")))
                    for hits in _meet(query, low, high, part, k):
                        yield from table(*hits)
                    low = high

    return both.mapInArrow(run, "query_id long, database_id long, score double, compared long")
