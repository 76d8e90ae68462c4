import numpy as np
import pytest

from geocurate.llm import whiten
from geocurate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_against_the_definition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r.vec_id: tuple(int(np.floor(256 * float(c))) for c in r.embedding) for r in table}
    distinct = np.array(sorted(set(x.values())), float)
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True))
    n, sums = len(distinct), [sum(c) for c in zip(*set(x.values()))]
    rows = QUERIES["op12_whitening"](spark, SF).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, c) for i in x for c in (1, 2, 3, 4))
    signs = {}
    for r in rows:
        e, v = values[-r.component], vectors[:, -r.component]
        want = float((np.array(x[r.vec_id]) - np.array(sums) / n) @ v / np.sqrt(e))
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert abs(sign * r.whitened - want) < 1e-9 and r.n == n
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert abs(r.explained / (e / values.sum()) - 1) < 1e-10 and r.identity_error < 1e-10


@pytest.mark.parametrize("case", ["random", "scaled", "equal values", "dependent", "constant", "graded"])
def test_solver_against_lapack(case):
    rng = np.random.default_rng(3)
    x = rng.integers(-99, 100, (60, 12))
    if case == "scaled":
        x = x * 10 ** rng.integers(0, 6, 12)
    if case == "equal values":
        x = np.concatenate([np.eye(12, dtype=int) * 5, -np.eye(12, dtype=int) * 5])
    if case == "dependent":
        x[:, 5], x[:, 7] = x[:, 4], x[:, 3] + 2 * x[:, 2]
    if case == "constant":
        x[:] = x[0]
    if case == "graded":
        x = x * 2 ** np.arange(0, 36, 3)
    sums = [int(s) for s in x.sum(0)]
    centred = x - np.array(sums) / len(x)
    found = whiten.solve(np.linalg.qr(centred, mode="r"), len(x), sums)
    values = np.linalg.svd(centred, compute_uv=False) ** 2 / len(x)
    k = {"dependent": 10, "constant": 0}.get(case, 12)
    assert len(found.values) == k
    # LAPACK's own small values are only good to the largest one's rounding
    assert np.allclose(found.values, values[:k], rtol=1e-6 if case == "graded" else 1e-9, atol=0)
    assert np.abs(found.directions.T @ found.directions - np.eye(k)).max(initial=0) < 1e-13
    white = found.rows(x)
    assert np.abs(white.T @ white / len(x) - np.eye(k)).max(initial=0) < (1e-4 if case == "graded" else 1e-10)


def test_copies_odd_rows_and_other_columns(spark):
    nan = float("nan")
    rows = [(i, [float(i % 7), float(i * i % 5), 1.0]) for i in range(40)]
    odd = [(50, None), (51, [nan, 1.0, 1.0]), (52, [None, 1.0, 1.0]), (53, [1.0, float("-inf"), 1.0])]
    kind = "vec_id long, embedding array<double>, x int, _v string"
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd + [rows[3]] * 20 + [(None, rows[4][1])]], kind)
    white, fitted, error = whiten.whiten(df)
    got = white.collect()
    assert fitted.n == 21 and len(fitted.values) == 2 and error < 1e-12  # the third dimension is constant
    assert len(got) == 61 and len({tuple(r.whitened) for r in got if r.vec_id == 3}) == 1
    assert {r.vec_id for r in got} == {None, *range(40)}


def test_tables_without_directions(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        white, fitted, error = whiten.whiten(spark.createDataFrame(rows, kind))
        assert all(r.whitened == [] for r in white.collect()) and error == 0 and not len(fitted.values)
    with pytest.raises(ValueError, match="1 to 2"):
        whiten.whiten(spark.createDataFrame([(1, [2.0]), (2, [2.0, 1.0])], kind))


def test_large_entries(spark):
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(i, [float(2**40 + 3 * i), float(-i * i)]) for i in range(9)], kind)
    n, sums = whiten.moments(whiten.quantise(df, "vec_id", "embedding", 256.0))
    assert (n, sums) == (9, [256 * (9 * 2**40 + 3 * 36), -256 * 204])
    with pytest.raises(Exception, match="too large"):
        whiten.quantise(spark.createDataFrame([(1, [1e300])], kind), "vec_id", "embedding", 256.0).collect()
    with pytest.raises(Exception, match="64 bits"):
        whiten.whiten(spark.createDataFrame([(i, [i * 1e11]) for i in range(99)], kind))[0].collect()
