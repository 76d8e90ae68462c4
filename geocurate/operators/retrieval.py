"""Exact nearest neighbours and Recall@k."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geocurate.functions import vectors as V
from geocurate.operators import blocks as B
from geocurate.operators import pivots
from geocurate.runtime import stage

#: Queries are broadcast in parts of at most this many bytes.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

_HITS = pa.schema([("query_id", pa.int64()), ("database_id", pa.int64()), ("score", pa.float64())])


def knn(
    queries: DataFrame,
    database: DataFrame,
    k: int,
    vector: str = "embedding",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    rows: int | None = None,
) -> DataFrame:
    """The k database images of largest cosine per query: rank 1.. by score, then id.

    Queries that a broadcast of *max_broadcast_bytes* holds are sent to the database: a task
    streams its part past them, holds the k best of each, and emits them once at its end; a
    window limited to k merges the parts.  More queries are searched by blocks around
    pivots (:mod:`pivots`, at most *rows* in a block), which moves the database once for each 16,384 queries.
    """
    if queries.count() * 8 * max(1, B.vector_size(queries, vector)) > max_broadcast_bytes:
        return pivots.search(pivots.build(database, vector, rows=rows), queries, k, vector)[0]
    return _search(queries, database, k, vector, _cosine_scores, max_broadcast_bytes, None)


def hamming_shortlist(
    queries: DataFrame,
    database: DataFrame,
    k: int,
    code: str = "code",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Like :func:`knn` for packed sign codes; ``score`` is minus the Hamming distance."""
    return _search(queries, database, k, code, _hamming_scores, max_broadcast_bytes, None)


def two_stage(
    queries: DataFrame, database: DataFrame, shortlist: int, k: int,
    width: int, vector: str = "embedding",
) -> DataFrame:
    """Shortlist by sign codes, then rank the shortlist by cosine."""

    def coded(df: DataFrame) -> DataFrame:
        return df.select("image_id", V.sign_code(F.col(vector), width).alias("code"))

    near = hamming_shortlist(coded(queries), coded(database), shortlist)
    q = queries.select(F.col("image_id").alias("query_id"), F.col(vector).alias("_q"))
    d = database.select(F.col("image_id").alias("database_id"), F.col(vector).alias("_d"))
    scored = (
        near.select("query_id", "database_id")
        .join(d, "database_id").join(q, "query_id")
        .select("query_id", "database_id", V.cosine(F.col("_q"), F.col("_d")).alias("score"))
    )
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("database_id"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(queries, database, k, vector, scores, max_broadcast_bytes, rows) -> DataFrame:
    spark = database.sparkSession
    dim = B.vector_size(queries, vector)
    n = queries.count()
    held = n if not dim else max(1, max_broadcast_bytes // (8 * dim))
    held = rows if rows and held < rows else held
    chunks = max(1, -(-n // max(1, held)))
    q = queries.select("image_id", F.col(vector).alias("v"))
    d = database.select("image_id", F.col(vector).alias("v"))
    parts = []
    for chunk in range(chunks):
        own = q if chunks == 1 else q.filter(F.pmod(F.xxhash64("image_id"), F.lit(chunks)) == chunk)
        table = own.orderBy("image_id").toArrow().combine_chunks()  # about max_broadcast_bytes
        if not table.num_rows:
            continue
        sent = spark.sparkContext.broadcast((table.column("image_id").to_numpy(), table.column("v").combine_chunks()))
        hits = d.mapInArrow(_running_best(sent, k, scores), "query_id long, database_id long, score double")
        parts.append(stage(top_k(hits, k), "neighbours").df)
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, database_id long, score double, rank int")
    return reduce(DataFrame.unionByName, parts)


def _running_best(sent: Broadcast, k: int, scores: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best database rows of a partition per query, kept while its rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors = sent.value
        rows = B.rows_per_block(len(query_vectors.values) // max(1, len(query_vectors)))
        best = np.full((len(query_ids), 0), 0.0)
        ids = np.zeros((len(query_ids), 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                new_ids = part.column("image_id").to_numpy()
                for low in range(0, len(query_ids), rows):  # bounds the table of scores
                    line = scores(query_vectors.slice(low, rows), part.column("v"))
                    width = min(k, line.shape[1])
                    floor = -np.partition(-line, width - 1, axis=1)[:, width - 1]
                    if low == 0:
                        next_best, next_ids = [], []
                    for at, (values, least) in enumerate(zip(line, floor), low):
                        near = np.flatnonzero(values >= least)
                        value = np.concatenate([best[at], values[near]])
                        name = np.concatenate([ids[at], new_ids[near]])
                        order = np.lexsort((name, -value))[:k]
                        next_best.append(value[order])
                        next_ids.append(name[order])
                best, ids = np.stack(next_best), np.stack(next_ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(query_ids, ids.shape[1])), pa.array(ids.ravel()), pa.array(best.ravel())], schema=_HITS
        )

    return run


def _rows_of(vectors: pa.ListArray, dtype=np.float64) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=dtype).reshape(len(vectors), -1)


def _cosine_scores(q: pa.ListArray, d: pa.ListArray) -> np.ndarray:
    return B.unit_rows(_rows_of(q)) @ B.unit_rows(_rows_of(d)).T


def _hamming_scores(q: pa.ListArray, d: pa.ListArray) -> np.ndarray:
    a, b = _rows_of(q, np.int64).view(np.uint64), _rows_of(d, np.int64).view(np.uint64)
    out = np.zeros((len(a), len(b)))
    for word in range(a.shape[1]):
        out -= np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return out


def recall_at(
    neighbours: DataFrame, gold: DataFrame, queries: DataFrame, database: DataFrame, ks: Sequence[int]
) -> DataFrame:
    """(k, recall): share of queries with a gold image among the first k.

    Queries without gold count as misses.  The recall is NaN where k exceeds the
    number of retrieved images (the database size) and 0 without queries.
    """
    first = (
        neighbours.join(gold, ["query_id", "database_id"], "left_semi")
        .groupBy("query_id").agg(F.min("rank").alias("first"))
    )
    n_database = database.count()
    width = min(max(ks), n_database)
    judged = queries.select(F.col("image_id").alias("query_id")).join(first, "query_id", "left")
    rows = judged.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("first") <= k).alias(f"hit_{k}") for k in ks]
    )
    pairs = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"hit_{k}").alias("hits")) for k in ks])
    return (
        rows.select("n", F.explode(pairs).alias("p"))
        .select(
            F.col("p.k").alias("k"),
            F.when(F.col("p.k") > width, F.lit(float("nan")))
            .when(F.col("n") == 0, F.lit(0.0))
            .otherwise(F.try_divide(F.col("p.hits"), F.col("n")))
            .alias("recall"),
        )
    )


def mean_r1(recalls: DataFrame) -> DataFrame:
    """Mean of R@1 over the datasets, NaN left out."""
    return recalls.filter(F.col("k") == 1).agg(
        F.avg(F.when(~F.isnan("recall"), F.col("recall"))).alias("mean_r1")
    )
