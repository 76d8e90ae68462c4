import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocurate.llm import lm
from geocurate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in QUERIES["op4_pitman_yor_scores"](spark, SF).collect()}


def test_counts_and_base_match_brute_force(spark, scored):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(t for i, text in texts.items() if i not in held for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert scored.keys() == texts.keys()
    for i, text in texts.items():
        row, own = scored[i], tokens(text)
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (i in held, len(own), n)
        assert row.n_known == sum(c[t] > 0 for t in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)


def test_model_beats_the_base_on_unseen_documents(scored):
    unseen = [r for r in scored.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in scored.values())


def test_probabilities_sum_to_one(spark):
    rows = [("the a the b the c",), ("the a of b of the",), ("",), (None,), ("a " * 400,), ("x y z the x",)]
    model = lm.train(spark.createDataFrame(rows, "text string"))
    words = model.words.df
    unknown = spark.range(1).select(F.lit(None).cast("array<int>").alias("ctx"), *(
        F.lit(None).cast(k).alias(n) for n, k in (("direct", "array<double>"), *((c, "long") for c in lm._BY_SAMPLE))))
    for ctx in range(len(model.contexts) + 1):
        known = words.agg(F.sum(model.probability(F.lit(ctx)))).first()[0]
        assert known + unknown.select(model.probability(F.lit(ctx))).first()[0] == pytest.approx(1.0, abs=1e-9)


def test_seating_follows_the_exact_distribution():
    def joint(c, weight, d):
        """Weights of the numbers of tables, by adding up all seatings."""
        states = {(): 1.0}
        for _ in range(c):
            after = Counter()
            for sizes, p in states.items():
                after[tuple(sorted((*sizes, 1)))] += p * weight
                for k in range(len(sizes)):
                    grown = tuple(sorted((*sizes[:k], sizes[k] + 1, *sizes[k + 1:])))
                    after[grown] += p * (sizes[k] - d)
            states = after
        out = Counter()
        for sizes, p in states.items():
            out[len(sizes)] += p
        return np.array([out[t] for t in range(1, c + 1)]) / sum(out.values())

    draws = 40_000
    noise = np.random.default_rng(1).integers(0, 1 << 62, draws).astype(np.uint64)
    for c, weight, d in ((2, 0.3, 0.5), (5, 2.0, 0.7), (7, 0.05, 0.2)):
        got = lm.seat(np.full(draws, c), np.full(draws, weight), d, noise)
        share = np.bincount(got, minlength=c + 1)[1:] / draws
        assert np.abs(share - joint(c, weight, d)).max() < 0.012
    many = lm.seat(np.array([1, 200, 100_000]), np.array([0.1, 0.1, 5.0]), 0.6, noise[:3])
    assert many[0] == 1 and (many <= [1, 200, 100_000]).all()


def test_contexts_and_odd_tables(spark):
    w = lm.tokens("b A c a")
    contexts = np.sort(w[[1]])
    assert lm.contexts_of(w, contexts).tolist() == [0, 0, 1, 1, 1]
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, None, 0), (None, "zz", 0)], "doc_id long, text string, score int")
    model = lm.train(docs.filter("doc_id = 1"))
    rows = lm.score(docs, model).collect()
    assert len(rows) == 4 and sorted(r.n_tokens for r in rows) == [1, 2, 3, 3]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    empty = docs.limit(0)
    assert lm.score(empty, model).count() == 0
    assert [r.n_known for r in lm.score(docs.filter("doc_id = 2"), lm.train(empty)).collect()] == [0]
