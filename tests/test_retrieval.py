import math

import numpy as np
from pyspark.sql import functions as F

from geocurate.operators import matches, retrieval


def scene(spark, n=300, seed=4, extent=60.0):
    rng = np.random.default_rng(seed)
    rows = [(i, bool(i % 5 == 0), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, extent, size=(n, 2)))]
    return rows, spark.createDataFrame(rows, "image_id long, is_query boolean, utm_east double, utm_north double")


def near(rows, r):
    return {
        (q[0], d[0]) for q in rows if q[1] for d in rows if not d[1]
        and (q[2] - d[2]) ** 2 + (q[3] - d[3]) ** 2 <= r * r
    }


def test_radius_pairs_with_and_without_fragments(spark):
    rows, df = scene(spark)
    for cell_rows in (4096, 3):
        got = {tuple(r) for r in matches.radius_pairs(df, 7.0, cell_rows).collect()}
        assert got == near(rows, 7.0)


def test_crowded_position(spark):
    df = spark.createDataFrame(
        [(i, i < 20, 5.0, 5.0) for i in range(120)], "image_id long, is_query boolean, utm_east double, utm_north double"
    )
    assert matches.radius_pairs(df, 25, cell_rows=7).distinct().count() == 2000


def test_distance_of_exactly_the_radius_counts(spark):
    df = spark.createDataFrame(
        [(0, True, 0.0, 0.0), (1, False, 25.0, 0.0), (2, False, 25.0001, 0.0), (3, True, 500.0, 0.0), (4, False, -15.0, -20.0)],
        "image_id long, is_query boolean, utm_east double, utm_north double",
    )
    got = {r["image_id"]: r["matches"] for r in matches.add_matches(df, 25).collect()}
    assert got == {0: [1, 4], 1: None, 2: None, 4: None}


def test_missing_position_matches_nothing(spark):
    df = spark.createDataFrame(
        [(0, True, None, 0.0), (1, False, 0.0, 0.0)], "image_id long, is_query boolean, utm_east double, utm_north double"
    )
    assert matches.radius_pairs(df, 25).count() == 0


def vectors(spark, ids, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(len(ids), 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "image_id long, embedding array<double>")
    return df, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_knn_matches_brute_force_on_both_paths(spark):
    q, qx = vectors(spark, range(23), 1)
    d, dx = vectors(spark, range(100, 300), 2)
    best = np.argsort(-(qx @ dx.T), axis=1)[:, :5] + 100
    for options in ({}, {"max_broadcast_bytes": 0, "rows": 7}):
        got = retrieval.knn(q, d, 5, **options).orderBy("query_id", "rank").collect()
        assert [r["database_id"] for r in got] == best.ravel().tolist()


def test_knn_ties_go_to_the_smaller_id(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "image_id long, embedding array<double>")
    d = spark.createDataFrame([(i, [2.0, 0.0]) for i in (9, 4, 7)], "image_id long, embedding array<double>")
    assert [r["database_id"] for r in retrieval.knn(q, d, 2).orderBy("rank").collect()] == [4, 7]


def test_recall_edges(spark):
    q, _ = vectors(spark, range(4), 1)
    d, _ = vectors(spark, range(10, 13), 2)
    found = retrieval.knn(q, d, 5)
    gold = found.filter((F.col("rank") == 2) & (F.col("query_id") < 2)).select("query_id", "database_id")
    got = {r["k"]: r["recall"] for r in retrieval.recall_at(found, gold, q, d, [1, 2, 3, 5]).collect()}
    assert (got[1], got[2], got[3]) == (0.0, 0.5, 0.5) and math.isnan(got[5])
    none = retrieval.recall_at(found.limit(0), gold, q.limit(0), d, [1]).first()
    assert none["recall"] == 0.0


def test_recall_grows_with_k(spark):
    q, _ = vectors(spark, range(30), 7)
    d, _ = vectors(spark, range(100, 160), 8)
    found = retrieval.knn(q, d, 20)
    gold = q.select(F.col("image_id").alias("query_id"), (F.col("image_id") + 100).alias("database_id"))
    recalls = [r["recall"] for r in retrieval.recall_at(found, gold, q, d, [1, 5, 10, 20]).orderBy("k").collect()]
    assert recalls == sorted(recalls)


def test_two_stage_with_full_shortlist_is_exact(spark):
    q, _ = vectors(spark, range(6), 3)
    d, _ = vectors(spark, range(50, 90), 5)
    exact = retrieval.knn(q, d, 3).select("query_id", "database_id", "rank").collect()
    staged = retrieval.two_stage(q, d, shortlist=40, k=3, width=12).select("query_id", "database_id", "rank").collect()
    assert sorted(map(tuple, exact)) == sorted(map(tuple, staged))


def test_ground_truth_ignores_unknown_ids(spark):
    df = spark.createDataFrame(
        [(0, True, [5, 6, 99]), (1, True, []), (2, True, None), (5, False, []), (6, False, None)],
        "image_id long, is_query boolean, matches array<long>",
    )
    assert {r["image_id"]: r["gold"] for r in matches.ground_truth(df).collect()} == {0: [5, 6], 1: [], 2: []}


def test_radius_pairs_read_the_images_once_and_copy_queries_to_four_cells(spark, monkeypatch):
    seen, copies = spark.sparkContext.accumulator(0), []
    rows, df = scene(spark, n=400, seed=9)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stage = matches.stage
    monkeypatch.setattr(matches, "stage", lambda d, label: copies.append(label) or stage(d, label))
    for radius in (0.5, 3.0, 11.0):
        before = seen.value
        got = [tuple(r) for r in matches.radius_pairs(df.mapInArrow(count, df.schema), radius).collect()]
        assert len(got) == len(set(got)) and set(got) == near(rows, radius)
        assert seen.value - before == len(rows)
    assert copies == ["spots", "cells"] * 3


def test_crowded_cells_are_not_copied(spark, monkeypatch):
    """30,000 images in a cell meet in one task: neither side is copied for fragments of the other."""
    i, cells = F.col("id"), []
    spot = F.when(i % 3 == 0, 18.0).otherwise(1.0) + (i % 100) / 100.0
    df = spark.range(30_000).select(
        i.alias("image_id"), (i % 3 == 0).alias("is_query"),
        F.when(i == 0, 5.0).otherwise(spot).alias("utm_east"), F.when(i == 0, 5.0).otherwise(spot).alias("utm_north"),
    )
    stage = matches.stage

    def kept(d, label):
        made = stage(d, label)
        cells.extend(made.df.collect() if label == "cells" else [])
        return made

    monkeypatch.setattr(matches, "stage", kept)
    assert {tuple(r) for r in matches.radius_pairs(df, 10.0).collect()} == {(0, d) for d in range(30_000) if d % 3}
    assert cells and {(c["fd"], c["fq"]) for c in cells} == {(1, 1)}


def test_strips_hold_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(3)
    e, n = (np.round(rng.normal(0, 12, 4000), 1) + 551000 for _ in range(2))
    odd = [(4000, False, float("nan"), 551000.0), (4001, True, float("inf"), 551000.0), (4002, False, float("inf"), 551000.0)]
    rows = [(k, bool(k % 5 == 0), float(a), float(b)) for k, (a, b) in enumerate(zip(e, n))]
    df = spark.createDataFrame(rows + odd, "image_id long, is_query boolean, utm_east double, utm_north double")
    for radius, cell_rows in ((5.0, 1 << 18), (0.5, 300), (0.0, 1 << 18)):
        got = [tuple(r) for r in matches.radius_pairs(df, radius, cell_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == near(rows, radius) and got
