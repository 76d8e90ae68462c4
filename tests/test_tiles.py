"""Mining with each sample moved about once, whatever the number of pairs."""

import pytest

from geocurate.operators import blocks, mining, tiles
from tests.test_batches import brute_force, samples


@pytest.fixture
def written(monkeypatch):
    labels, stage = [], mining.stage
    monkeypatch.setattr(mining, "stage", lambda df, label: labels.append(label) or stage(df, label))
    return labels


def test_hard_pairs_are_not_written(spark, written):
    rows, df = samples(spark)
    mined = mining.mine_pairs(df, 0.1)
    got = {(r["anchor_id"], r["other_id"], r["positive"]) for r in mined.collect()}
    assert got == brute_force(rows, 0.1)[0] and written == ["extremes"]


def no_pairs_of_blocks(*args, **options):
    raise AssertionError("every block was copied to every other")


def test_extremes_copy_no_blocks(spark, monkeypatch):
    rows, df = samples(spark, n=150, batches_=1)
    whole = sorted(mining.extremes(df).collect())
    monkeypatch.setattr(blocks, "pair_up", no_pairs_of_blocks)
    small = sorted(mining.extremes(df, rows=3).collect())
    for a, b in zip(whole, small, strict=True):
        assert tuple(a) == pytest.approx(tuple(b))


@pytest.mark.parametrize("held", [1, 13, 59])
def test_batches_larger_than_a_task_holds(spark, held):
    rows, df = samples(spark)
    pairs, hits, _ = brute_force(rows, 0.1)
    mined = mining.mine_pairs(df, 0.1, held=held)
    found = [(r["anchor_id"], r["other_id"], r["positive"]) for r in mined.collect()]
    assert len(found) == len(pairs) and set(found) == pairs
    accuracy = mining.batch_accuracy(mining.extremes(df, 5, held))
    assert {r["batch_id"]: r["accuracy"] for r in accuracy.collect()} == pytest.approx(hits)


def test_single_samples_and_samples_drawn_twice(spark):
    df = spark.createDataFrame(
        [(0, 1, 5, [1.0, 0.0]), (1, 2, 5, [1.0, 0.0]), (1, 2, 5, [1.0, 0.0]), (1, 3, 6, [0.6, 0.8])],
        "batch_id long, sample_id long, label long, embedding array<double>",
    )
    got = {(r.batch_id, r.sample_id): r for r in mining.extremes(df).collect()}
    assert sorted(got) == [(0, 1), (1, 2), (1, 3)]
    assert got[(0, 1)].near == float("-inf") and got[(0, 1)].low_positive == float("inf")
    assert got[(1, 2)].near_id == 3 and got[(1, 2)].high_negative == pytest.approx(0.6)


def test_losses_without_pairs(spark, monkeypatch, written):
    rows, df = samples(spark)
    monkeypatch.setattr(mining, "mine_pairs", no_pairs_of_blocks)
    for held in (None, 17):
        got = {r["batch_id"]: r["loss"] for r in mining.mined_loss(df, 0.2, held=held).collect()}
        assert got == pytest.approx(brute_force(rows, 0.2)[2])
    assert set(written) == {"extremes"}


def test_losses_of_batches_without_pairs_are_zero(spark):
    df = spark.createDataFrame(
        [(0, 1, 5, [1.0, 0.0]), (0, 2, 5, [0.0, 1.0]), (1, 3, 5, [1.0, 0.0])],
        "batch_id long, sample_id long, label long, embedding array<double>",
    )
    assert sorted(mining.mined_loss(df).collect()) == [(0, 0.0), (1, 0.0)]


def test_copies_don_t_grow_with_the_input(spark, monkeypatch):
    """More rows are larger parts, until they fill a task, and not more copies of each row."""
    assert [tiles.held_rows(64, n, 12) for n in (1_000, 100_000, 615_384, 10 ** 8)] == [8_192, 8_192, 25_641, 125_000]
    assert tiles.held_rows(8_000, 10 ** 6, 12) == 1_000
    rows, df = samples(spark, n=150, batches_=1)
    found, stage = [], tiles.stage
    monkeypatch.setattr(tiles, "HELD_ROWS", 2)
    monkeypatch.setattr(tiles, "CORE_PARTS", 4 / spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(tiles, "stage", lambda d, label: found.append(label) or stage(d, label))
    pairs = mining.mine_pairs(df, 0.1)
    assert {(r["anchor_id"], r["other_id"], r["positive"]) for r in pairs.collect()} == brute_force(rows, 0.1)[0]
    parts = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "38.0" in parts and set(found) == {"part_counts"}
