import pytest
from pyspark.sql import functions as F

from geocurate.operators import ids, places
from geocurate.operators.checks import DataCheckError

MATCHED = [
    ("a1", "place_a", ["a2", "b1", "c1"]), ("a2", "place_a", ["a1", "b1"]), ("b1", "place_b", ["a1", "b2"]),
    ("b2", "place_b", ["b1"]), ("c1", "place_c", ["a1"]),
]


def manifest(spark, rows):
    return spark.createDataFrame(
        rows, "image_id long, source string, utm_east double, utm_north double, heading double, place_id long"
    )


def test_remove_small_places(spark):
    df = spark.createDataFrame(MATCHED, "image_id string, place_id string, matches array<string>")
    kept = places.remove_small_places(df, 2).orderBy("image_id").collect()
    assert [r["image_id"] for r in kept] == ["a1", "a2", "b1", "b2"]
    assert [r["matches"] for r in kept] == [["a2", "b1"], ["a1", "b1"], ["a1", "b2"], ["b1"]]


def test_remove_small_places_can_be_off(spark):
    df = spark.createDataFrame([("a1", "a"), ("b1", "b")], "image_id string, place_id string")
    assert places.remove_small_places(df, 1) is df


def test_remove_small_places_keeps_emptied_lists(spark):
    df = spark.createDataFrame(
        [("a1", "a", ["b1"]), ("a2", "a", None), ("b1", "b", ["a1"])],
        "image_id string, place_id string, matches array<string>",
    )
    kept = {r["image_id"]: r["matches"] for r in places.remove_small_places(df, 2).collect()}
    assert kept == {"a1": [], "a2": None}


def test_remove_unmatched(spark):
    df = spark.createDataFrame([(["a"],), ([],), (None,)], "matches array<string>")
    assert [r["matches"] for r in places.remove_unmatched(df).collect()] == [["a"]]


def test_assign_places_mixes_given_and_grid(spark):
    df = manifest(spark, [
        (0, "b", 10.0, 10.0, 0.0, 7), (1, "a", 10.0, 10.0, 0.0, 7), (2, "a", 10.0, 10.0, 0.0, 9),
        (3, "c", 12.0, 26.0, 90.0, None), (4, "c", 12.0, 26.0, 95.0, None), (5, "c", 12.0, 0.0, 0.0, None),
    ])
    got = {r["image_id"]: r for r in places.assign_places(df, 10.0, 60.0).collect()}
    assert [got[i]["place_id"] for i in (0, 1, 2)] == [2, 0, 1]
    # cells (1, 2, 1) and (1, 0, 0) with 3 north and 2 heading values, shifted by 3
    assert [got[i]["place_id"] for i in (3, 4, 5)] == [3 + 6 + 4 + 1, 3 + 6 + 4 + 1, 3 + 6]
    assert (got[0]["cell_x"], got[0]["cell_y"], got[0]["cell_h"]) == (1, 1, 0)


def test_assign_places_needs_headings(spark):
    df = manifest(spark, [(0, "a", 1.0, 1.0, None, None), (1, "a", 1.0, 1.0, float("nan"), None)])
    with pytest.raises(DataCheckError, match="2 of 2"):
        places.assign_places(df, 10.0, 60.0)
    assert places.assign_places(df, 10.0, None).count() == 2


def test_assign_places_rejects_negative_cells(spark):
    df = manifest(spark, [(0, "a", 1.0, -1.0, 0.0, None)])
    with pytest.raises(DataCheckError, match="negative"):
        places.assign_places(df, 10.0, 60.0)


def test_subsample_bounds(spark):
    df = manifest(spark, [(i, "a", float(i * 100), 0.0, 0.0, i) for i in range(10)])
    for fraction in (0.0, 1.5):
        with pytest.raises(DataCheckError):
            places.subsample_source_places(df, "a", fraction)
    with pytest.raises(DataCheckError):
        places.subsample_tiles(df, 0.0)
    assert places.subsample_source_places(df, "a", 1.0).count() == 10
    assert places.subsample_tiles(df, 1.5) is df
    assert places.subsample_tiles(df, 0.01).count() == 1
    kept = places.subsample_source_places(df, "a", 0.35).collect()
    assert sorted(r["place_id"] for r in kept) == [0, 1, 2] and sorted(r["image_id"] for r in kept) == [0, 1, 2]


def test_subsample_keeps_other_sources_of_a_shared_place(spark):
    rows = [(i, "a", 0.0, 0.0, 0.0, i % 4) for i in range(8)] + [(8 + i, "b", 0.0, 0.0, 0.0, i) for i in range(4)]
    kept = places.subsample_source_places(manifest(spark, rows), "a", 0.5).collect()
    assert sum(r["source"] == "b" for r in kept) == 4 and sum(r["source"] == "a" for r in kept) == 4


def test_dense_ids_and_ranks(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = ids.dense_ids(df, ["k"], "n").collect()
    assert all(r["k"] == r["n"] for r in got) and len(got) == 1000
    ranked = ids.rank_in_group(df, ["g"], ["k"], "r").collect()
    for g in range(3):
        mine = sorted((r["k"], r["r"]) for r in ranked if r["g"] == g)
        assert [r for _, r in mine] == list(range(len(mine)))
    assert ids.dense_ids(df.limit(0), ["k"], "n").count() == 0


def test_combine_renumbers(spark):
    a = manifest(spark, [(0, "a", 0.0, 0.0, 0.0, 1), (1, "a", 0.0, 0.0, 0.0, 1)])
    b = a.drop("place_id").withColumn("source", F.lit("b"))
    got = places.combine([b, a]).orderBy("image_id").collect()
    assert [(r["image_id"], r["source"], r["place_id"]) for r in got] == [
        (0, "b", None), (1, "b", None), (2, "a", 1), (3, "a", 1),
    ]


def test_removing_small_places_counts_them_once_and_sends_back_lost_matches_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, i // 4 if i < 36 else i, [i + 1, None, i - 1, i + 1, 99] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "image_id long, place_id long, matches array<long>")
    got = {r.image_id: r.matches for r in places.remove_small_places(df.mapInArrow(count, df.schema), 2).collect()}
    assert got == {i: None if m is None else [x for x in m if x is not None and 0 <= x < 36] for i, _, m in rows if i < 36}
    assert seen.value <= 4 * len(rows)  # the places, the images that stay, the lost matches, the result


def test_images_whose_matches_all_fell_with_their_places_are_removed(spark):
    df = spark.createDataFrame(
        [("a1", "a", ["c1"]), ("a2", "a", ["c1", "a1"]), ("b1", "b", ["a1"]), ("b2", "b", []), ("c1", "c", ["a1"])],
        "image_id string, place_id string, matches array<string>",
    )
    left = places.remove_unmatched(places.remove_small_places(df, 2))
    assert {r.image_id: r.matches for r in left.collect()} == {"a2": ["a1"], "b1": ["a1"]}
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "posexplode" not in plan  # matches that stay are not sent back
