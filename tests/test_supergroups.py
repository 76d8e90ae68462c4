import numpy as np
import pytest
from pyspark.sql import functions as F

from geocurate.operators import supergroups
from geocurate.operators.checks import DataCheckError


def table(spark, counts):
    rows = [(i, g) for i, g in enumerate(g for g, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "place_id long, outer_group long")


def test_allocation_rounds_halves_to_even(spark):
    # 16 places and size 4 make 4 clusters: shares 0.5, 1.5, 2.0 and 1.5, 2.5
    got = supergroups.allocate_k(table(spark, {0: 2, 1: 6, 2: 8}), 4).orderBy("outer_group").collect()
    assert [r["k"] for r in got] == [1, 2, 2] and [r["first"] for r in got] == [0, 1, 3]
    got = supergroups.allocate_k(table(spark, {0: 6, 1: 10}), 4).orderBy("outer_group").collect()
    assert [r["k"] for r in got] == [2, 2]


def test_allocation_never_exceeds_the_places(spark):
    got = supergroups.allocate_k(table(spark, {0: 1, 1: 1}), 1).collect()
    assert all(r["k"] == 1 for r in got)
    one = supergroups.allocate_k(table(spark, {5: 3}), 1000).first()
    assert (one["k"], one["first"]) == (1, 0)


def points(spark, n=120, groups=2, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, i % groups, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "place_id long, outer_group long, embedding array<double>")


def test_kmeans_paths_agree_and_labels_are_nearest(spark):
    df = points(spark)
    share = spark.createDataFrame([(0, 5), (1, 3)], "outer_group long, k long")
    a = supergroups.spherical_kmeans(df, share, max_iter=4).toPandas()
    b = supergroups.spherical_kmeans(df, share, max_iter=4, rows=2, max_broadcast_bytes=0).toPandas()
    key = ["place_id", "outer_group", "cluster"]
    assert (a.sort_values("place_id")[key].to_numpy() == b.sort_values("place_id")[key].to_numpy()).all()
    assert a[a.outer_group == 0].cluster.max() < 5 and a[a.outer_group == 1].cluster.max() < 3
    assert len(a) == 120


def test_kmeans_converges_to_a_fixed_point(spark):
    df = points(spark, n=60, groups=1)
    share = spark.createDataFrame([(0, 4)], "outer_group long, k long")
    labels = supergroups.spherical_kmeans(df, share, max_iter=50).toPandas().sort_values("place_id")
    x = np.array(df.orderBy("place_id").toPandas()["embedding"].tolist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = labels["cluster"].to_numpy()
    centre = np.stack([x[label == c].sum(axis=0) for c in range(4)])
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    assert ((x @ centre.T).argmax(axis=1) == label).all()


def test_assignment_refines_outer_groups(spark):
    rng = np.random.default_rng(0)
    images = spark.createDataFrame(
        [(i, i // 3, (i // 3) % 6, (i // 3) // 6, 0) for i in range(108)],
        "image_id long, place_id long, cell_x long, cell_y long, cell_h long",
    )
    vectors = spark.createDataFrame(
        [(p, [float(x) for x in rng.normal(size=4)]) for p in range(36)], "place_id long, embedding array<double>"
    )
    out = supergroups.assign_supergroups(images, vectors, size=4, spatial=2, angular=2, max_iter=5)
    assert out.count() == 108
    tagged = supergroups.outer_groups(out, 2, 2)
    assert tagged.groupBy("supergroup_id").agg(F.count_distinct("outer_group").alias("n")).filter("n > 1").count() == 0
    assert out.groupBy("place_id").agg(F.count_distinct("supergroup_id").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(DataCheckError, match="1 place_ids"):
        supergroups.assign_supergroups(images, vectors.filter("place_id <> 7"), size=4, spatial=2)
