import numpy as np
import pyarrow as pa
import pytest

from geocurate.operators import pivots, retrieval

KIND = "image_id long, embedding array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], KIND)


def exact(q, d, k):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    score = np.round(unit(q) @ unit(d).T, 12)
    return [np.lexsort((np.arange(len(d)), -line))[:k].tolist() for line in score]


def clustered(seed, n, spread=0.05, centres=25, dim=8):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(0).normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("spread", [0.05, 3.0])
@pytest.mark.parametrize("rows", [16, 300])
def test_same_as_brute_force(spark, spread, rows):
    d, q = clustered(1, 900, spread), clustered(2, 70, spread)
    found, report = pivots.search(pivots.build(frame(spark, d), rows=rows), frame(spark, q, 5000), 7)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id - 5000, []).append((r["rank"], r.database_id))
    assert [[i for _, i in sorted(got[n])] for n in range(len(q))] == exact(q, d, 7)
    line = report.first()
    assert 0 < line.compared <= line.pairs
    if spread == 0.05 and rows == 16:
        assert line.compared < 0.5 * line.pairs  # most blocks are never read


def test_zero_vectors_copies_and_small_databases(spark):
    d = np.concatenate([np.zeros((3, 4)), np.repeat(np.eye(4)[:1], 40, 0), -np.eye(4)])
    q = np.concatenate([np.zeros((1, 4)), np.eye(4)])
    for k in (3, 60):
        found, _ = pivots.search(pivots.build(frame(spark, d), rows=4), frame(spark, q), k)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.database_id))
        assert [[i for _, i in sorted(got[n])] for n in range(len(q))] == exact(q, d, k)
    one, _ = pivots.search(pivots.build(frame(spark, d[-1:])), frame(spark, q), 5)
    assert one.count() == len(q)


def test_no_queries(spark):
    found, report = pivots.search(pivots.build(frame(spark, np.eye(3))), frame(spark, np.eye(3)).limit(0), 2)
    assert found.count() == 0 and report.first().compared == 0


def test_large_query_sets_read_the_database_once(spark, monkeypatch):
    """Beyond a broadcast the index takes over, with the result of the other path."""
    d, q = clustered(3, 200), clustered(4, 40)
    a = retrieval.knn(frame(spark, q), frame(spark, d), 5)
    monkeypatch.setattr(retrieval, "_search", None)
    b = retrieval.knn(frame(spark, q), frame(spark, d), 5, max_broadcast_bytes=0, rows=16)
    key = lambda df: sorted((r.query_id, r["rank"], r.database_id) for r in df.collect())
    assert key(b) == sorted((r.query_id, r["rank"], r.database_id) for r in a.collect())


def ranks(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id - 5000, []).append((r["rank"], r.database_id))
    return {n: [i for _, i in sorted(v)] for n, v in got.items()}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_more_rows_than_a_task_holds(spark, monkeypatch, spread):
    monkeypatch.setattr(pivots, "PART_ROWS", 40)
    monkeypatch.setattr(pivots, "ASKED_ROWS", 11)
    d, q = clustered(7, 300, spread), clustered(8, 90, spread)
    found, _ = pivots.search(pivots.build(frame(spark, d), rows=8), frame(spark, q, 5000), 7)
    assert ranks(found) == dict(enumerate(exact(q, d, 7)))


def test_written_rows_do_not_grow_with_pairs_of_blocks(spark, monkeypatch):
    """Neither pairs of blocks nor copies that tie with the last neighbour are written."""
    counts, stage = [], pivots.stage

    def counted(df, label):
        done = stage(df, label)
        counts.append(done.df.count())
        return done

    monkeypatch.setattr(pivots, "stage", counted)
    d, q = clustered(7, 500, 3.0), clustered(8, 60, 3.0)
    found, _ = pivots.search(pivots.build(frame(spark, d), rows=2), frame(spark, q, 5000), 7)
    assert ranks(found) == dict(enumerate(exact(q, d, 7)))
    assert sum(counts) < 5 * (len(d) + len(q) * 7)
    counts.clear()
    copies = np.tile(d[:1], (400, 1))
    found, _ = pivots.search(pivots.build(frame(spark, copies), rows=64), frame(spark, copies[:40], 5000), 3)
    assert set(map(tuple, ranks(found).values())) == {(0, 1, 2)}
    assert sum(counts) < 3 * (400 + 40 * 3)


def test_most_scores_are_neither_ordered_nor_made_in_double_precision(spark):
    """The k best of a part that nothing can be left out of, from a bound for each query."""
    rng = np.random.default_rng(9)
    d, q = rng.normal(size=(3000, 16)), rng.normal(size=(40, 16))
    d[2000:2010] = d[5]
    part, asked = side(d), side(q)
    a, b, score, limit = pivots._best(asked.u, part, None, 7)
    exact_score = asked.u @ part.u.T
    assert np.allclose(score, exact_score[a, b], rtol=0, atol=1e-15) and len(a) < 40 * 40
    last = np.sort(exact_score, axis=1)[:, -7]
    assert (limit <= last).all() and (last - limit < 0.2).all()
    best = [sorted(zip(-score[a == n], b[a == n]))[:7] for n in range(len(q))]
    assert [[i for _, i in line] for line in best] == exact(q, d, 7)


def side(x):
    rows = pa.array([[{"id": i, "v": v.tolist()} for i, v in enumerate(x)]])
    return pivots._Side([pa.RecordBatch.from_arrays([rows], ["rows"])])
