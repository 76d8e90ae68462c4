import numpy as np
import pytest
from pyspark.sql import functions as F

from geocurate.llm import lm


def test_rare_word_is_a_context(spark):
    """No word but 'the' reaches a 200th of the tokens; what follows a rare word is still learned."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        k = rng.permutation(300)[:6]
        rows.append((i, " ".join(f"the left{j} right{j}" for j in k)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs)
    probes = [(0, "the left7 right7"), (1, "the left7 right8")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(probes, "doc_id long, text string"), model).collect()}
    assert got[0].n_known == got[1].n_known == 4
    assert got[0].score > got[1].score + 1


def test_light_contexts_sum_to_one(spark):
    """Over the vocabulary and the unknown word, by the joined tables that score() uses, after a heavy, a rare and an unseen word."""
    docs = spark.createDataFrame([("the a the b the c",), ("x y z the x",), ("a " * 400,), (None,)], "text string")
    model = lm.train(docs)
    seen = [r.w for r in model.words.df.select("w").collect()]
    contexts = lm.tokens("the x unseen")[:3].view(np.int64).tolist() + [int(lm.END)]
    rows = [(u, w) for u in contexts for w in [*seen, 12345]]
    from geocurate.runtime import stage

    wanted = stage(spark.createDataFrame(rows, "u long, w long"), "wanted").df
    sums = model.pair_scores(wanted).groupBy("u").agg(F.sum(F.pow(F.lit(10.0), "pair_score")).alias("p")).collect()
    assert len(sums) == 4 and all(r.p == pytest.approx(1.0, abs=1e-9) for r in sums)


def test_large_dishes_are_drawn():
    """Tables of a large dish vary as seating its customers one by one does after the exact draw, not by rounding alone."""
    draws, c, weight, d = 4000, 600, 6.0, 0.5
    noise = np.random.default_rng(2).integers(0, 1 << 62, draws).astype(np.uint64)
    got = lm.seat(np.full(draws, c), np.full(draws, weight), d, noise)
    rng, t = np.random.default_rng(3), lm.seat(np.full(draws, lm.EXACT), np.full(draws, weight), d, noise).astype(float)
    for n in range(lm.EXACT, c):
        t += rng.random(draws) < weight / (n - d * t + weight)
    assert got.mean() == pytest.approx(t.mean(), rel=0.02)
    assert got.std() == pytest.approx(t.std(), rel=0.08)
