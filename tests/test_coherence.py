import numpy as np
import pytest

from geocurate.operators import aggregate, coherence
from geocurate.operators.places import place_sizes


def images(spark, groups):
    rows, number = [], 0
    for place, vectors in groups.items():
        for v in vectors:
            rows.append((number, place, [float(x) for x in v]))
            number += 1
    return spark.createDataFrame(rows, "image_id long, place_id long, embedding array<double>")


def one_by_one(vectors, tau):
    """Drop the worst image again and again, with the full similarity matrix each time."""
    u = np.asarray(vectors, dtype=float)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    alive = list(range(len(u)))
    while len(alive) > 1:
        sim = u[alive] @ u[alive].T
        np.fill_diagonal(sim, 0.0)
        mean = sim.sum(axis=1) / (len(alive) - 1)
        worst = int((mean <= mean.min() + 1e-12).argmax())  # of equal scores the smallest id
        if mean[worst] >= tau:
            break
        alive.pop(worst)
    return alive


def random_groups(seed, sizes, dim=6, lean=0.7):
    rng = np.random.default_rng(seed)
    out = {}
    for place, n in enumerate(sizes):
        centre = rng.normal(size=dim)
        out[place] = lean * centre + rng.normal(size=(n, dim))
    return out


def expected(groups, tau, min_images):
    want, start = set(), 0
    for vectors in groups.values():
        alive = one_by_one(vectors, tau)
        if len(alive) >= min_images:
            want |= {start + i for i in alive}
        start += len(vectors)
    return want


@pytest.mark.parametrize("tau", [-1.0, 0.1, 0.3, 0.6])
def test_filter_matches_brute_force(spark, tau):
    groups = random_groups(3, [1, 2, 5, 17, 40, 8])
    got = coherence.coherence_filter(images(spark, groups), tau=tau, min_images=2).collect()
    assert {r["image_id"] for r in got} == expected(groups, tau, 2)


@pytest.mark.parametrize(("limit", "candidates"), [(4, 2), (9, 4)])
def test_large_places_take_rounds_with_the_same_result(spark, limit, candidates):
    groups = random_groups(5, [3, 16, 10, 5], dim=5, lean=0.5)
    got = coherence.coherence_filter(
        images(spark, groups), tau=0.25, min_images=3, max_task_values=limit * 5, round_candidates=candidates
    ).collect()
    assert {r["image_id"] for r in got} == expected(groups, 0.25, 3)


def test_single_and_opposed_images(spark):
    df = images(spark, {0: [[1, 0]], 1: [[1, 0], [-1, 0]], 2: [[1, 0], [1, 0.1]]})
    kept = coherence.coherence_filter(df, tau=0.3, min_images=2).collect()
    assert sorted(r["place_id"] for r in kept) == [2, 2]
    alone = coherence.coherence_filter(df, tau=0.3, min_images=1).collect()
    assert sorted(r["place_id"] for r in alone) == [0, 1, 2, 2]


def test_survivors_reach_the_threshold(spark):
    groups = random_groups(11, [25, 9, 14, 3])
    kept = coherence.coherence_filter(images(spark, groups), tau=0.3, min_images=4, keep_vector=True)
    assert place_sizes(kept).filter("num_images < 4").count() == 0
    assert coherence.coherence(kept).filter("coherence < 0.3 - 1e-9").count() == 0


def test_scores_agree_on_both_paths(spark):
    df = images(spark, random_groups(2, [1, 6, 21]))
    a = {r["image_id"]: r["coherence"] for r in coherence.coherence(df).collect()}
    b = {r["image_id"]: r["coherence"] for r in coherence.coherence(df, max_task_values=12).collect()}
    assert a.keys() == b.keys() and a[0] is None and b[0] is None
    assert all(abs(a[i] - b[i]) < 1e-12 for i in a if a[i] is not None)


@pytest.mark.parametrize("limit", [10**6, 40])
def test_carried_means_equal_the_aggregate(spark, limit):
    df = images(spark, random_groups(8, [12, 4, 25, 1]))
    options = {"tau": 0.2, "min_images": 2, "max_task_values": limit}
    carried = coherence.coherence_filter(df, place_mean=True, **options)
    a = {r["place_id"]: r["embedding"] for r in aggregate.carried_embeddings(carried).collect()}
    kept = coherence.coherence_filter(df, keep_vector=True, **options)
    b = {r["place_id"]: r["embedding"] for r in aggregate.place_embeddings(kept).collect()}
    assert a.keys() == b.keys() and a
    assert all(a[p] == pytest.approx(b[p]) for p in a)


def test_empty_input(spark):
    df = images(spark, {0: [[1.0, 0.0]]}).limit(0)
    assert coherence.coherence_filter(df).count() == 0


def test_place_embeddings(spark):
    df = images(spark, {0: [[1, 0], [0, 1]], 1: [[1, 0], [-1, 0]]})
    got = {r["place_id"]: r["embedding"] for r in aggregate.place_embeddings(df).collect()}
    assert got[0] == pytest.approx([0.5**0.5, 0.5**0.5]) and got[1] == [0.0, 0.0]
    with pytest.raises(ValueError, match="median"):
        aggregate.place_embeddings(df, "median")
