import random

import numpy as np
import pytest

from geocurate.llm import ngram_join as J
from geocurate.runtime import path_exists


def brute(texts):
    """doc -> (size, component) by comparing every pair."""
    sets = [J.shingles_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for k in range(i):
            a, b = sets[i], sets[k]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    passage = prose(30)
    texts = [None, "", " \t\n", "one", "ONE", "one two three four", "One  Two\nthree four", "a b c d e", "a b c d e f"]
    for _ in range(40):
        base = prose(rng.choice([6, 9, 20, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):  # chains of edits
            base = list(base)
            for _ in range(max(1, len(base) // rng.choice([25, 40, 60]))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
        if rng.random() < 0.3:
            texts.append(" ".join(prose(40) + passage + prose(40)))
    texts += rng.sample(texts, 12)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("frequent,points", [(100, 2048), (3, 6)])
def test_matches_brute_force(spark, monkeypatch, frequent, points):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "TREE_POINTS", points)
    texts = corpus(frequent)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs).collect()}
    assert got == brute(texts)


def test_without_the_stars(spark, monkeypatch):
    """The tree alone must find every link."""
    verify, calls = J._verify, []

    def first_is_empty(pairs, rows):
        calls.append(1)
        return verify(pairs.limit(0) if len(calls) == 1 else pairs, rows)

    monkeypatch.setattr(J, "_verify", first_is_empty)
    texts = corpus(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs).collect()} == brute(texts)


def test_tree_misses_no_point():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 9, (12, J.GROUPS))
    points = np.maximum(0, np.repeat(centres, 60, 0) + rng.integers(-1, 2, (720, J.GROUPS)) * (rng.random((720, 1)) < 0.3))
    sizes = points.sum(axis=1)
    q, p = J.Tree(points, sizes).search(points, sizes)
    overlap = np.minimum(points[:, None], points[None]).sum(axis=2)
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(9 * overlap >= 4 * (sizes[:, None] + sizes)))))


def test_empty_and_odd_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(empty).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x y"), (2, None)]
    got = sorted(map(str, map(tuple, J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (2, 0, 2)]))


def test_hash_sets_have_the_size_of_the_sets():
    for text in corpus(4):
        assert len(J.shingle_hashes(text)) == len(J.shingles_of(text))


def test_blocks_of_the_same_documents_are_searched_once(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    other = list(words)
    for at in rng.sample(range(400), 10):  # about 50 of 396 shingles differ, which is too many for a link
        other[at] = "x"
    search, rows = J._search_blocks, []
    monkeypatch.setattr(J, "_search_blocks", lambda cells: rows.append(cells.count()) or search(cells))
    monkeypatch.setattr(J, "_verify", lambda pairs, _: pairs.filter("false"))
    texts = [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert J.join(docs).count() == 2
    assert rows == [2]  # one block of two documents, however many shingles they share


def test_a_pair_leaves_the_search_with_all_its_meetings(spark):
    point = np.full(J.GROUPS, 1, "<u2").tobytes()
    names = "route long, key long, one int, two int, part int, weight long, id long, label long, n long, point binary"
    # n = 128: 25 shingles lie in the first parts at least, of which 2 must be shared
    rows = [(7, key, 0, 0, 0, 1, i, i, 128, point) for key in (1, 2) for i in (1, 2)]
    rows += [(8, 3, 0, 0, 0, 1, i, i, 128, point) for i in (3, 4)]
    found = J._search_blocks(spark.createDataFrame(rows, names)).collect()
    least = -((-4 * 256) // 9) - int(J._rest(np.array([128]))[0])
    assert sorted(map(tuple, found)) == sorted(p for p, met in (((1, 2), 2), ((3, 4), 1)) if met >= least)


def _unlinked_copies(n):
    """Texts that differ in more places than a link allows, and each the last by one word."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(n):
        text = list(words)
        for at in rng.sample(range(200), 4):
            text[at] = f"x{i}"
        texts.append(" ".join(text))
    return texts + [texts[0] + f" y{i}" for i in range(n // 4)]


def test_a_pair_meets_in_one_task_for_all_blocks_with_one_smallest_id(spark, monkeypatch):
    texts = _unlinked_copies(320)
    search, seen = J._search_blocks, []
    monkeypatch.setattr(J, "_search_blocks", lambda cells: seen.extend(cells.drop("point").collect()) or search(cells))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.join(docs).collect()}
    assert got == {i: c for i, (_, c) in brute(texts).items()}
    first, cells = {}, {}
    for r in seen:
        first[r.key] = min(r.id, first.get(r.key, r.id))
        cells.setdefault((r.route, r.key, r.one, r.two), []).append(r)
    met = []  # the smallest id of the block, the pair and the route, wherever a pair meets
    for (route, key, one, two), rows in cells.items():
        labels, ids, parts = (np.array([getattr(r, c) for r in rows]) for c in ("label", "id", "part"))
        meet = (labels[:, None] != labels) & (ids[:, None] < ids) & ((parts[:, None] != parts) if one != two else True)
        a, b = np.nonzero(meet)
        met.append(np.stack([np.full(len(a), first[key]), ids[a], ids[b], np.full(len(a), route)]))
    met = np.unique(np.concatenate(met, axis=1), axis=1)
    pairs = np.unique(met[:3], axis=1).shape[1]
    assert met.shape[1] == pairs > 5000
    assert max(np.unique([r.route for r in seen], return_counts=True)[1]) < len(seen) / 3


def test_first_shingles_leave_the_disk_before_keys_are_written(spark, monkeypatch):
    stage, made, left = J.stage, [], {}

    def watched(df, label):
        left[label] = [s.path for s in made if "first" in s.df.columns and path_exists(spark, s.path)]
        made.append(stage(df, label))
        return made[-1]

    monkeypatch.setattr(J, "stage", watched)
    texts = corpus(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute(texts)
    assert left["profiles"] and not left["keyed"]
