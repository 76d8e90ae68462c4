import numpy as np
import pytest
from pyspark.sql import functions as F

from geocurate.operators import coherence, elimination

KIND = "image_id long, place_id long, tag string, embedding array<double>"


def random_places(seed, sizes, dim=6, lean=0.6):
    rng, rows = np.random.default_rng(seed), []
    for place, n in enumerate(sizes):
        for v in lean * rng.normal(size=dim) + rng.normal(size=(n, dim)):
            rows.append((len(rows), place * 3, f"t{len(rows)}", [float(x) for x in v]))
    return rows


def definition(rows, up_to):
    """Step and reach by the full matrix of similarities, image by image."""
    out = {}
    for place in {r[1] for r in rows}:
        ids = [r[0] for r in rows if r[1] == place]
        u = {r[0]: np.array(r[3]) / max(np.linalg.norm(r[3]), 1e-12) for r in rows if r[1] == place}
        step, top = 0, -np.inf
        while len(ids) > 1:
            score = {i: np.mean([u[i] @ u[j] for j in ids if j != i]) for i in ids}
            worst = min(ids, key=lambda i: (round(score[i], 12), i))
            top = max(top, score[worst])
            if top >= up_to:
                break
            step += 1
            out[worst] = (step, top)
            ids.remove(worst)
    return out


PATHS = [{}, {"max_task_values": 4 * 6, "round_candidates": 3}, {"max_task_values": 12 * 6, "round_candidates": 50}]


@pytest.mark.parametrize("options", PATHS)
def test_order_and_means_match_the_definition(spark, options, monkeypatch):
    monkeypatch.setattr(elimination.B, "BLOCK_ROWS", 7)  # several blocks a place
    rows = random_places(4, [1, 2, 30, 9, 55, 16])
    taus = (-1.0, 0.1, 0.25, 0.4)
    order = elimination.elimination(spark.createDataFrame(rows, KIND), taus, place_means=True, **options)
    got = {r.image_id: r for r in order.collect()}
    want = definition(rows, 0.4)
    assert set(got) == {r[0] for r in rows}
    for i, r in got.items():
        if i in want:
            assert r.step == want[i][0] and r.reach == pytest.approx(want[i][1], abs=1e-9)
        else:
            assert r.step is None and r.reach is None
    for at, tau in enumerate(taus):
        alive = {r.image_id for r in elimination.survivors(order, tau).collect()}
        assert alive == {i for i in got if tau <= -1 or i not in want or want[i][1] >= tau}
        for place in {r[1] for r in rows}:
            own = sorted(i for i in alive if got[i].place_id == place)
            mean = np.mean([r[3] for r in rows if r[0] in own], axis=0)
            assert got[own[0]].place_means[at] == pytest.approx(list(mean))
            assert all(got[r[0]].place_means[at] is None for r in rows if r[1] == place and r[0] != own[0])


@pytest.mark.parametrize("options", PATHS)
@pytest.mark.parametrize("tau", [0.2, 0.3, 0.4])
def test_one_order_equals_separate_filters(spark, options, tau):
    df = spark.createDataFrame(random_places(9, [12, 40, 3]), KIND)
    order = elimination.elimination(df, [0.4], **options)
    alone = coherence.coherence_filter(df, tau=tau, min_images=1, **options)
    assert {r.image_id for r in elimination.survivors(order, tau).collect()} == {r.image_id for r in alone.collect()}


def test_ties_fall_by_id_and_tables_may_be_empty(spark):
    rows = [(i, 1, "x", v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])]
    for options in PATHS:
        df = spark.createDataFrame(rows, KIND)
        got = {r.image_id: r.step for r in elimination.elimination(df, [0.9], **options).collect()}
        assert got == {4: 1, 0: 2, 2: 3, 1: None, 3: None}
        empty = elimination.elimination(df.limit(0), [0.5], place_means=True, **options)
        assert empty.count() == 0 and empty.columns == ["image_id", "place_id", "tag", "step", "reach", "place_means"]


def test_no_round_moves_the_vectors_of_large_places(spark):
    """The blocks are read where they lie: nothing between their scan and the scoring shuffles them."""
    df = spark.createDataFrame(random_places(1, [60, 30]), KIND)
    blocks = elimination.place_blocks(df, "embedding", 6)
    state = blocks.df.select("place_id", "blk", "nblk").withColumn("_s", F.array_repeat(F.lit(1.0), 6)).withColumn("_n", F.lit(9).cast("long"))
    state = state.withColumn("_reach", F.lit(0.0)).withColumn("_steps", F.lit(0).cast("long")).withColumn("_gone", F.array().cast("array<long>"))
    for broadcast in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        plan = elimination.candidates_of(blocks, state, 5)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "rows" in line]
        assert "place_blocks" in plan and not moved
    blocks.drop()


@pytest.mark.parametrize("means", [False, True])
def test_rounds_grow_with_the_logarithm_of_the_drops(spark, means, monkeypatch):
    rounds, candidates_of = [], elimination.candidates_of
    monkeypatch.setattr(elimination, "candidates_of", lambda *a: rounds.append(a[2]) or candidates_of(*a))
    rows = random_places(5, [220], lean=0.3)
    df = spark.createDataFrame(rows, KIND)
    if means:
        order = elimination.elimination(df, [0.4], place_means=True, max_task_values=19 * 6, round_candidates=3)
        left = {r.image_id for r in order.filter("step IS NULL").collect()}
    else:
        left = {r.image_id for r in coherence.coherence_filter(df, tau=0.4, min_images=1, max_task_values=19 * 6, round_candidates=3).collect()}
    gone = definition(rows, 0.4)
    assert left == {r[0] for r in rows} - set(gone)
    assert len(gone) > 100 and len(rounds) <= 16
    assert rounds[:3] == [3, 6, 12]
