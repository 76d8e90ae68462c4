import numpy as np
import pytest
from pyspark.sql import functions as F

from geocurate.operators import batches, checks, mining
from geocurate.operators.checks import DataCheckError

INDEX = "image_id string, image_path string, place_id string, supergroup_id int"


def index(spark, sizes, supergroups=None):
    rows = []
    for place, n in sizes.items():
        for i in range(n):
            rows.append((f"{place}{i}", f"/{place}{i}.jpg", place, (supergroups or {}).get(place, 0)))
    return spark.createDataFrame(rows, INDEX)


def test_one_place_of_five_images(spark):
    got = batches.draw_images(index(spark, {"p": 5}), 3).collect()
    assert len({r["image_id"] for r in got}) == 3 and {r["place_id"] for r in got} == {"p"}


def test_short_places(spark):
    df = index(spark, {"a": 2, "b": 3})
    with pytest.raises(DataCheckError, match="smallest place with 2"):
        batches.draw_images(df, 3, strict=True)
    got = batches.draw_images(df, 3).collect()
    assert sorted((r["place_id"], r["slot"]) for r in got) == [(p, s) for p in "ab" for s in range(3)]
    assert {r["image_id"] for r in got if r["place_id"] == "a"} <= {"a0", "a1"}


def test_batch_of_two_places_and_two_images(spark):
    df = index(spark, {"p0": 4, "p1": 4, "p2": 4}).withColumn(
        "place_id", F.substring("place_id", 2, 1).cast("long")
    )
    plan = batches.epoch_plan(df, 2, drop_last=True)
    samples = batches.collate(plan, df, 2)
    rows = samples.collect()
    assert len(rows) == 4 and {r["supergroup_id"] for r in rows} == {0} and len({r["label"] for r in rows}) == 2
    assert checks.require_pure_batches(samples) is samples


def test_draw_is_repeatable_and_depends_on_the_seed(spark):
    df = index(spark, {"p": 40, "q": 30})
    a, b, c = (sorted(r["image_id"] for r in batches.draw_images(df, 4, seed).collect()) for seed in (1, 1, 2))
    assert a == b != c


def test_plan_covers_every_place_once(spark):
    df = index(spark, {f"p{i}": 1 for i in range(25)}, {f"p{i}": i % 3 for i in range(25)})
    plan = batches.epoch_plan(df, 4)
    assert plan.select("place_id").distinct().count() == plan.count() == 25
    assert checks.mixed_batches(plan).count() == 0
    n = plan.select("batch_id").distinct().count()
    assert n == batches.epoch_length(df, 4).first()["batches"] == 7
    ids = sorted(r["batch_id"] for r in plan.select("batch_id").distinct().collect())
    assert ids == list(range(n))
    full = batches.epoch_plan(df, 4, drop_last=True)
    assert full.count() == 24 and batches.epoch_length(df, 4, True).first()["batches"] == 6


def test_mixed_batches_are_an_error(spark):
    bad = spark.createDataFrame([(0, 1), (0, 2)], "batch_id long, supergroup_id long")
    with pytest.raises(DataCheckError, match="1 batches"):
        checks.require_pure_batches(bad)


def samples(spark, n=60, labels=12, batches_=2, seed=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, 8))
    rows = []
    for b in range(batches_):
        for i in range(n):
            v = centre[i % labels] + rng.normal(size=8)
            rows.append((b, b * n + i, i % labels, [float(x) for x in v]))
    return rows, spark.createDataFrame(rows, "batch_id long, sample_id long, label long, embedding array<double>")


def brute_force(rows, epsilon):
    pairs, hits, losses = set(), {}, {}
    for b in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == b]
        x = np.array([r[3] for r in mine])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s, label = x @ x.T, np.array([r[2] for r in mine])
        hit, loss = 0, 0.0
        for i in range(len(mine)):
            other = np.arange(len(mine)) != i
            pos, neg = (label == label[i]) & other, label != label[i]
            hit += label[np.argmax(np.where(other, s[i], -9))] == label[i]
            low = s[i][pos].min() if pos.any() else np.inf
            high = s[i][neg].max() if neg.any() else -np.inf
            kept_p = np.flatnonzero(pos & (s[i] - epsilon < high))
            kept_n = np.flatnonzero(neg & (s[i] + epsilon > low))
            pairs |= {(mine[i][1], mine[j][1], bool(label[i] == label[j])) for j in (*kept_p, *kept_n)}
            loss += np.log1p(np.exp(-s[i][kept_p]).sum()) + np.log1p(np.exp(50 * s[i][kept_n]).sum()) / 50
        hits[b], losses[b] = hit / len(mine), loss / len(mine)
    return pairs, hits, losses


@pytest.mark.parametrize(("epsilon", "rows_per_block"), [(0.1, None), (0.05, 7), (0.2, 25)])
def test_mining_matches_brute_force(spark, epsilon, rows_per_block):
    rows, df = samples(spark)
    pairs, hits, losses = brute_force(rows, epsilon)
    mined = mining.mine_pairs(df, epsilon, rows_per_block)
    assert {(r["anchor_id"], r["other_id"], r["positive"]) for r in mined.collect()} == pairs
    got = {r["batch_id"]: r["loss"] for r in mining.batch_loss(df, mined).collect()}
    assert got == pytest.approx(losses)
    accuracy = mining.batch_accuracy(mining.extremes(df, rows_per_block))
    assert {r["batch_id"]: r["accuracy"] for r in accuracy.collect()} == pytest.approx(hits)


def test_samples_without_positives_or_negatives_mine_nothing(spark):
    df = spark.createDataFrame(
        [(0, 1, 5, [1.0, 0.0]), (0, 2, 5, [0.0, 1.0]), (1, 3, 5, [1.0, 0.0]), (1, 4, 6, [1.0, 0.1])],
        "batch_id long, sample_id long, label long, embedding array<double>",
    )
    mined = mining.mine_pairs(df, 0.1)
    assert mined.count() == 0
    assert [r["loss"] for r in mining.batch_loss(df, mined).collect()] == [0.0, 0.0]
