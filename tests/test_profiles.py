import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geocurate.operators import pairs, profile


def places(spark, sizes, seed=9, scale=100.0):
    rng = np.random.default_rng(seed)
    rows = []
    for group, n in sizes.items():
        for p in range(n):
            e, north = rng.uniform(0, scale, size=2)
            rows.append((group, group * 1000 + p, float(e), float(north), [float(x) for x in rng.normal(size=5)]))
    return rows, spark.createDataFrame(
        rows, "supergroup_id long, place_id long, utm_east double, utm_north double, embedding array<double>"
    )


def distances(rows, group):
    xy = np.array([r[2:4] for r in rows if r[0] == group])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=-1))
    return d[np.triu_indices(len(d), k=1)]


@pytest.mark.parametrize("block", [None, 3, 11])
def test_pair_statistics(spark, block):
    rows, df = places(spark, {0: 40, 1: 7, 2: 2})
    blocks = pairs.place_blocks(df, rows=block)
    moments = pairs.pair_moments(blocks, threshold=25.0)
    got = {r["supergroup_id"]: r for r in moments.collect()}
    median = {r["supergroup_id"]: r["median"] for r in pairs.pair_median(blocks, moments).collect()}
    for group in (0, 1, 2):
        d = distances(rows, group)
        r = got[group]
        assert (r["pairs"], r["under_threshold"]) == (len(d), int((d < 25).sum()))
        assert (r["low"], r["high"], r["mean"], r["std"]) == pytest.approx((d.min(), d.max(), d.mean(), d.std()))
        assert median[group] == pytest.approx(np.median(d), abs=1e-12)
    counts = {(r["supergroup_id"], r["bin"]): r["count"] for r in pairs.pair_histogram(blocks, moments).collect()}
    want, _ = np.histogram(distances(rows, 0), bins=60)
    assert [counts.get((0, b), 0) for b in range(60)] == want.tolist()


def test_equal_positions(spark):
    df = spark.createDataFrame(
        [(0, i, 1.0, 2.0) for i in range(5)], "supergroup_id long, place_id long, utm_east double, utm_north double"
    )
    blocks = pairs.place_blocks(df, rows=2)
    moments = pairs.pair_moments(blocks)
    assert pairs.pair_median(blocks, moments).first()["median"] == 0.0
    assert [tuple(r) for r in pairs.pair_histogram(blocks, moments).collect()] == [(0, 0, 10)]


def test_supergroup_quality(spark):
    rows, df = places(spark, {0: 12, 1: 3, 2: 1})
    got = {r["supergroup_id"]: r for r in profile.supergroup_quality(df.drop("embedding"), df).collect()}
    assert set(got) == {0, 1}
    x = np.array([r[4] for r in rows if r[0] == 0])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = (x @ x.T)[np.triu_indices(12, k=1)]
    xy = np.array([r[2:4] for r in rows if r[0] == 0])
    assert got[0]["mean_cosine"] == pytest.approx(sim.mean())
    assert got[0]["spread"] == pytest.approx(xy.std(axis=0).sum())
    assert got[0]["closest_pair"] == pytest.approx(distances(rows, 0).min())


def test_similarity_matrix_of_chosen_places(spark):
    _, df = places(spark, {0: 6})
    images = df.select(F.col("place_id").alias("image_id"), F.lit(1).cast("long").alias("place_id"), "embedding")
    got = pairs.similarity_matrix(images, [1], rows=2).collect()
    assert sum(len(r["others"]) for r in got) == 36
    for r in got:
        if r["image_id"] in r["others"]:
            assert r["similarities"][r["others"].index(r["image_id"])] == pytest.approx(1.0)
    assert pairs.similarity_matrix(images, [2]).count() == 0


def train(spark):
    rows = [(i, f"{i}.jpg", 0.0, 0.0, 0.0, "ab"[i % 7 == 0], i // 3, (i // 3) % 2) for i in range(20)]
    return spark.createDataFrame(
        rows,
        "image_id long, image_path string, utm_east double, utm_north double, heading double, source string, place_id long, supergroup_id long",
    )


def test_train_summary_blocks(spark):
    row = profile.train_summary(train(spark)).first()
    assert (row["num_images"], row["num_places"], row["num_supergroups"]) == (20, 7, 2)
    assert row["images_per_place"]["min"] == 2 and row["schema"]["columns"][0] == "image_id"
    blocks = {r["supergroup_id"]: r["num_places"] for r in profile.supergroup_stats(train(spark)).collect()}
    assert blocks == {0: 4, 1: 3}
    assert sum(s["num_images"] for s in row["sources"].values()) == 20
    plain = profile.train_summary(train(spark).drop("supergroup_id", "source")).first()
    assert plain["num_supergroups"] == 0 and "sources" not in plain


def test_single_place_source_has_no_deviation(spark):
    df = train(spark).withColumn("source", F.when(F.col("place_id") == 0, "x").otherwise("y"))
    got = {r["source"]: r for r in profile.source_stats(df).collect()}
    assert got["x"]["std"] == 0.0 and got["y"]["std"] > 0


def test_loader_summary_counts_local_places_per_supergroup(spark):
    local = train(spark).withColumn("place_id", F.floor(F.col("place_id") / 2).cast("long"))
    got = {r["measure"]: r for r in profile.loader_summary(local).collect()}
    assert got["images_per_place"]["mean"] == pytest.approx(20 / 7)


def test_eval_summary_without_queries(spark):
    df = spark.createDataFrame([(False, None)], "is_query boolean, matches array<long>")
    row = profile.eval_summary(df).first()
    assert (row["num_query_images"], row["queries_with_no_matches_pct"]) == (0, 0.0)


def test_samples(spark):
    df = train(spark)
    assert profile.sample_places(df, 2).groupBy("source").count().filter("count > 2").count() == 0
    assert profile.sample_places(df.drop("source"), 3).first()["source"] == "all"
    gallery = profile.sample_gallery(df, supergroups=1, places=2, images=1).collect()
    assert len(gallery) == 2 and len({r["supergroup_id"] for r in gallery}) == 1


def test_value_histogram_of_values_whose_last_bits_vary(spark):
    """Sums of doubles depend on the order of rows, which differs from one reading of a shuffle to the next."""

    def vary(batches):
        rng = np.random.default_rng()
        for batch in batches:
            v = batch.column(0).to_numpy() * (1 + 1e-12 * rng.uniform(-1, 1, batch.num_rows))
            yield batch.set_column(0, "v", pa.array(v))

    fixed = spark.range(0, 200, 1, 4).select((F.col("id") + 1000.5).alias("v"))
    for _ in range(3):
        got = sorted(map(tuple, pairs.value_histogram(fixed.mapInArrow(vary, fixed.schema), "v", 7).collect()))
        assert [b for b, _ in got] == list(range(7)) and sum(n for _, n in got) == 200
