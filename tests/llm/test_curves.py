import numpy as np
import pytest
from pyspark.sql import functions as F

from geocurate.llm import curves
from geocurate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def exact(rows, query, k):
    """The k nearest of (id, vector) *rows* to one of them, by definition."""
    own, at = query
    found = sorted({(float(np.sqrt(((np.array(v, float) - np.array(at, float)) ** 2).sum())), i) for i, v in rows if i != own})
    return found[:k]


def test_hilbert_keys_visit_every_cell_in_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_query_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in table]
    found = {}
    for r in QUERIES["op11_curve_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [(i, v) for i, v in rows if i % 100 == 0]
    assert sorted(found) == [i for i, _ in sorted(queries)]
    of, hit = dict(rows), 0
    for query in queries:
        own = sorted(found[query[0]])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        for _, i, s in own:
            assert s == float(np.sqrt(((np.array(of[i], float) - np.array(query[1], float)) ** 2).sum()))
        hit += len({i for _, i, _ in own} & {i for _, i in exact(rows, query, 10)})
    assert hit >= 0.9 * 10 * len(queries)


def test_recall_on_clustered_data_with_narrow_windows(spark, monkeypatch):
    """Low-dimensional structure and many small blocks: several groups and blocks of each curve."""
    monkeypatch.setattr(curves, "BLOCK_VALUES", 640)
    monkeypatch.setattr(curves, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16)) * 3
    points = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 16)) * 0.3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in curves.nearest(df, F.col("vec_id") % 30 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hit = sum(len(got[i] & {n for _, n in exact(rows, (i, v), 5)}) for i, v in rows if i % 30 == 0)
    assert len(got) == 100 and all(len(g) == 5 for g in got.values()) and hit >= 0.9 * 500


def test_copies_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [0.0, 1.0]), (0, [0.0, 1.0]), *((i, [0.0, 1.0]) for i in range(1, 40)), (200, [5.0, 1.0]), (201, [5.0, 2.0]), (202, [5.0, 0.0])]
    odd = [(300, None), (400, [0.0, 0.0]), (500, [nan, 1.0]), (600, [inf, 1.0]), (700, [None, 1.0]), (None, [1.0, 1.0]), (800, [])]
    df = spark.createDataFrame([(i, v, i or 0, [0], "x") for i, v in rows + odd + [rows[0], rows[5]]], "vec_id long, embedding array<float>, point long, ids array<int>, at string")
    got = {}
    for r in curves.nearest(df, F.col("vec_id") % 100 == 0, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    assert sorted(got) == [0, 100, 200]
    assert sorted(got[0]) == [(n, n, 0.0) for n in (1, 2, 3, 4)]
    assert sorted(got[100]) == [(n + 1, n, 0.0) for n in (0, 1, 2, 3)]
    assert sorted(got[200])[:2] == [(1, 201, 1.0), (2, 202, 1.0)] and [i for _, i, _ in sorted(got[200])[2:]] == [0, 1]


def test_few_or_no_candidates(spark):
    kind = "vec_id long, embedding array<float>"
    asked = F.col("vec_id") % 100 == 0
    assert curves.nearest(spark.createDataFrame([], kind), asked, 3).count() == 0
    assert curves.nearest(spark.createDataFrame([(100, [1.0, 2.0])], kind), asked, 3).count() == 0
    assert curves.nearest(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind), asked, 3).count() == 0
    few = curves.nearest(spark.createDataFrame([(0, [1.0]), (2, [2.0]), (1, [4.0])], kind), asked, 3).collect()
    assert [(r.rank, r.id, r.distance) for r in sorted(few, key=lambda r: r.rank)] == [(1, 2, 1.0), (2, 1, 3.0)]
    with pytest.raises(ValueError, match="1 to 2"):
        curves.nearest(spark.createDataFrame([(0, [1.0]), (2, [2.0, 1.0])], kind), asked, 3)
