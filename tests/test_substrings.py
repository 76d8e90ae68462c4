import numpy as np
import pytest

from geocurate.operators import substrings

KIND = "image_id long, code array<long>"


def frame(spark, codes, first=0):
    return spark.createDataFrame([(first + i, [int(w) for w in c]) for i, c in enumerate(codes)], KIND)


def exact(queries, database, k):
    far = np.array([[sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(q, d)) for d in database.tolist()] for q in queries.tolist()])
    return [[(int(line[i]), int(i)) for i in np.lexsort((np.arange(len(line)), line))[:k]] for line in far]


def codes(seed, n, width, near=None, flips=3):
    """Random codes, or such that differ from given ones in a few bits; as signed longs."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, width)) if near is None else near[rng.integers(0, len(near), n)].copy()
    if near is not None:
        for row in bits:
            row[rng.choice(width, flips, replace=False)] ^= 1
    words = -(-width // 64)
    padded = np.zeros((n, words * 64), np.uint64)
    padded[:, :width] = bits
    packed = (padded.reshape(n, words, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return packed.view(np.int64), bits


@pytest.mark.parametrize(("width", "bits"), [(64, 8), (100, 8), (128, 16), (24, 4)])
def test_same_as_a_full_scan(spark, width, bits):
    database, plain = codes(1, 300, width)
    queries, _ = codes(2, 12, width, plain, flips=min(4, width // 6))
    found, report = substrings.shortlist(substrings.build(frame(spark, database), width, bits), frame(spark, queries, 900), 6)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id - 900, []).append((r["rank"], r.differing, r.database_id))
    assert [[(d, i) for _, d, i in sorted(got[n])] for n in range(12)] == exact(queries, database, 6)
    assert [r.turned for r in report.collect()] == list(range(report.count()))


def test_close_codes_settle_early_and_ties_go_to_the_smaller_id(spark):
    _, plain = codes(3, 4, 64)
    database, _ = codes(4, 200, 64, plain, flips=1)
    queries, _ = codes(5, 8, 64, plain, flips=1)
    found, report = substrings.shortlist(substrings.build(frame(spark, database), 64, 8), frame(spark, queries), 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.differing, r.database_id))
    assert [sorted(got[n]) for n in range(8)] == exact(queries, database, 5)
    assert report.count() == 1  # two bits at most differ, so one of eight parts agrees


def test_small_and_empty_tables(spark):
    database, _ = codes(6, 3, 64)
    index = substrings.build(frame(spark, database), 64, 8)
    assert substrings.shortlist(index, frame(spark, database), 10)[0].count() == 9
    assert substrings.shortlist(index, frame(spark, database).limit(0), 10)[0].count() == 0
    empty = substrings.build(frame(spark, database).limit(0), 64, 8)
    assert substrings.shortlist(empty, frame(spark, database), 10)[0].count() == 0
    with pytest.raises(ValueError, match="7 bits"):
        substrings.build(frame(spark, database), 64, 7)
