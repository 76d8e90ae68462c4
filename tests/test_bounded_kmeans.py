import numpy as np
import pytest

from geocurate.operators import bounded_kmeans, supergroups


def lloyd(x, centres, steps):
    """Every point against every centroid, step by step; ties to the smaller cluster."""
    labels = None
    for step in range(steps + 1):
        new = np.round(x @ centres.T, 14).argmax(axis=1)
        if labels is not None and (new == labels).all() or step == steps:
            return new
        labels = new
        for c in range(len(centres)):
            total = x[labels == c].sum(axis=0)
            if (labels == c).any():
                centres[c] = total / (np.linalg.norm(total) or 1.0)
    return labels


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
@pytest.mark.parametrize("steps", [0, 2, 60])
def test_same_labels_as_lloyd_steps(spark, broadcast, steps):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(9, 6))
    x = centre[rng.integers(0, 9, 160)] + 0.35 * rng.normal(size=(160, 6))
    x[7] = 0.0
    x[20:24] = x[20]
    df = spark.createDataFrame([(i, i % 2, [float(c) for c in v]) for i, v in enumerate(x)], "place_id long, outer_group long, embedding array<double>")
    share = spark.createDataFrame([(0, 11), (1, 7)], "outer_group long, k long")
    got = supergroups.spherical_kmeans(df, share, max_iter=steps, rows=4, max_broadcast_bytes=broadcast)
    got = {r.place_id: r.cluster for r in got.collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    import hashlib

    for group, k in ((0, 11), (1, 7)):
        ids = [i for i in range(160) if i % 2 == group]
        first = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:k]
        want = lloyd(unit[ids], unit[first].copy(), steps)
        assert [got[i] for i in ids] == want.tolist()


def test_settled_blocks_are_not_compared_again(spark, monkeypatch):
    """Far apart clusters: after the first steps no block is open, so the centroids go nowhere."""
    seen = []
    compare = bounded_kmeans._compare

    def counted(points, state, *rest):
        seen.append(state.count())
        return compare(points, state, *rest)

    monkeypatch.setattr(bounded_kmeans, "_compare", counted)
    rng = np.random.default_rng(5)
    axis = np.eye(4)[np.arange(64) % 4]
    rows = [(i, 0, [float(c) for c in v]) for i, v in enumerate(axis + 0.02 * rng.normal(size=(64, 4)))]
    df = spark.createDataFrame(rows, "place_id long, outer_group long, embedding array<double>")
    share = spark.createDataFrame([(0, 6)], "outer_group long, k long")
    supergroups.spherical_kmeans(df, share, max_iter=30, rows=5, max_broadcast_bytes=0).count()
    assert seen[0] == max(seen) > min(seen[1:]) and len(seen) < 30


def test_no_step_shuffles_the_points(spark):
    df = spark.range(40).selectExpr("id AS place_id", "0L AS outer_group", "array(cast(id AS double), 1.0D) AS v")
    packed = bounded_kmeans.B.pack(df, ["outer_group"], "place_id", ["v"], 5)
    points = bounded_kmeans.B.BlockTable.write(packed, ["outer_group", "blk"], "kmeans_points")
    state = points.df.selectExpr("outer_group", "blk", "transform(rows, r -> 0L) AS label", "transform(rows, r -> 0D) AS upper", "transform(rows, r -> 0D) AS lower")
    centroids = spark.range(9).selectExpr("0L AS outer_group", "id AS cluster", "array(cast(id AS double), 1.0D) AS v")
    plan = bounded_kmeans._compare(points.df, state, centroids, "outer_group", 3, False)._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("kmeans_points")].splitlines()
    above = scan[scan.index(next(line for line in scan if "SortMergeJoin" in line)):]
    assert not any("Exchange" in line for line in above if "rows" in line)
    points.drop()
