import hashlib
import re

from geocurate.llm import dedup
from geocurate.llm.common import HEAVY_SHARE, components, join_lookup

KINDS = "doc_id long, text string, keep_id string"


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def decisions(df):
    return sorted(tuple(r) for r in df.collect() if r.doc_id is not None)


def test_decisions_and_later_deliveries(spark):
    index = dedup.DigestIndex.open(spark, buckets=4)
    first = [(5, "a  b", "x"), (3, "a\tb", "x"), (4, "c", "x"), (7, None, "x"), (8, "", "x"), (9, " ", "x"), (2, "a b", "x")]
    got = decisions(dedup.dedup(spark.createDataFrame(first, KINDS), index))
    assert got == sorted([
        (5, 3, 2, False, digest("a b")), (3, 3, 2, True, digest("a b")), (4, 4, 1, True, digest("c")),
        (7, 7, 2, True, digest("")), (8, 7, 2, False, digest("")), (9, 9, 1, True, digest(" ")), (2, 2, 1, True, digest("a b")),
    ])
    later = [(1, "a b", "x"), (10, "new", "x"), (11, "new", "x")]
    got = decisions(dedup.dedup(spark.createDataFrame(later, KINDS), index))
    assert got == [(1, 3, 1, False, digest("a b")), (10, 10, 2, True, digest("new")), (11, 10, 2, False, digest("new"))]
    again = dedup.DigestIndex.open(spark, index.path, buckets=4)
    assert sorted(r.keep_id for r in again.df.collect()) == [2, 3, 4, 7, 9, 10]


def test_null_ids_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a", "x"), (None, "b", "x"), (1, "a", "x"), (1, "a", "x")], KINDS)
    got = dedup.dedup(rows, dedup.DigestIndex.open(spark, buckets=2)).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got) == sorted([
        "(None, 1, 3, False)", "(None, None, 1, False)", "(1, 1, 3, True)", "(1, 1, 3, True)"])
    index = dedup.DigestIndex.open(spark, buckets=2)
    assert dedup.dedup(rows.limit(0), index).count() == 0 and index.df.count() == 0
    assert dedup.drop_copies(rows, index).columns == ["doc_id", "text", "keep_id"]


def test_hot_keys_are_broadcast_and_the_rest_shuffled(spark):
    rows = spark.range(4 * HEAVY_SHARE).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS v")
    lookup = rows.groupBy("k").count()
    got = join_lookup(rows, lookup, "k", "count")
    assert got.count() == rows.count()
    assert got.filter("k = 0 AND count = (SELECT 1334)").count() == 1334


def test_components_of_chains_stars_and_cycles(spark):
    import random

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    edges += [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(110)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    links = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(links.limit(0)).count() == 0
