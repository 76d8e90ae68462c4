"""Sources on real files, sinks, keyed stages, incremental embedding."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geocurate.operators import embed, report
from geocurate.operators.checks import DataCheckError
from geocurate.sources import cities, images, sinks, tables
from geocurate.streaming import embed_stream


def touch(*paths):
    for path in paths:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(b"x")


def test_named_tree(spark, folder):
    touch(
        f"{folder}/b/@10@20@@@@@@@30@.jpg", f"{folder}/b/sub/@1@2@@@@@@@3@.PNG",
        f"{folder}/a/@5@6@@@@@@@7@.jpeg", f"{folder}/a/readme.txt",
    )
    got = images.read_sf_xl(spark, [f"{folder}/b", f"{folder}/a"], folder).orderBy("image_id").collect()
    assert [r["image_path"] for r in got] == ["b/@10@20@@@@@@@30@.jpg", "b/sub/@1@2@@@@@@@3@.PNG", "a/@5@6@@@@@@@7@.jpeg"]
    assert [(r["image_id"], r["utm_east"], r["heading"]) for r in got] == [(0, 10.0, 30.0), (1, 1.0, 3.0), (2, 5.0, 7.0)]
    with pytest.raises(FileNotFoundError):
        images.read_msls(spark, [f"{folder}/none"], folder)
    touch(f"{folder}/a/@5@6@.jpg")
    with pytest.raises(DataCheckError, match="1 of 4"):
        images.read_msls(spark, [f"{folder}/b", f"{folder}/a"], folder)


def test_scan_does_not_read_contents(spark, folder):
    touch(f"{folder}/x/@1@2@.jpg")
    plan = images.scan_images(spark, [folder])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def pitts(n, yaw, east=0):
    return f"@{east}@0@10@S@3@4@pano{n}@{n}@@@@@@pitch1_yaw{yaw}@.jpg"


def test_pitts_tree(spark, folder):
    touch(*[f"{folder}/{pitts(n, yaw, east)}" for n, yaw, east in ((1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 1, 20))])
    got = {r["tile_num"]: r for r in images.read_pitts(spark, [folder], folder).collect()}
    assert [got[n]["heading"] for n in (1, 2, 3, 4)] == [0.0, 30.0, 60.0, 0.0]
    assert [got[n]["place_id"] for n in (1, 2, 3, 4)] == [0, 0, 1, 2]
    touch(f"{folder}/{pitts(5, 13)}")
    scan = images.scan_images(spark, [folder])
    assert images.malformed_pitts(scan).first()["problem"] == "yaw out of range"
    with pytest.raises(Exception, match="malformed panorama name"):
        images.read_pitts(spark, [folder], folder).count()


def test_city_files(spark, folder):
    head = "city_id,place_id,year,month,northdeg,lat,lon,panoid\n"
    for city, lines in {"Rome": ["Rome,3,2015,7,45,41.9,12.5,p1", "Rome,1,2016,11,5,41.8,12.4,p2"], "Oslo": ["Oslo,3,2014,1,359,59.9,10.7,p3"], "Bonn": ["Bonn,9,2014,1,0,50.7,7.1,p4"]}.items():
        with open(f"{folder}/{city}.csv", "w") as file:
            file.write(head + "\n".join(lines) + "\n")
    got = cities.read_cities(spark, folder).orderBy("image_id").collect()
    assert [r["place_id"] for r in got] == [9, 100003, 200003, 200001]
    assert got[2]["image_path"] == "Images/Rome/Rome_0000003_2015_07_045_41.9_12.5_p1.jpg"
    assert abs(got[1]["utm_north"] - 6.64e6) < 1e4 and got[1]["heading"] == 359.0
    picked = cities.read_cities(spark, folder, ["Rome", " Oslo "]).orderBy("image_id").collect()
    assert [r["place_id"] for r in picked] == [3, 100003, 100001]
    with pytest.raises(DataCheckError, match="Atlantis"):
        cities.read_cities(spark, folder, ["Atlantis"])


def test_eval_tree(spark, folder):
    touch(f"{folder}/q/@1@2@.jpg", f"{folder}/d/@3@4@.jpg", f"{folder}/d/@0@0@.jpg")
    got = images.read_eval(spark, f"{folder}/q", f"{folder}/d", folder).orderBy("image_id").collect()
    assert [(r["image_path"], r["is_query"]) for r in got] == [
        ("q/@1@2@.jpg", True), ("d/@0@0@.jpg", False), ("d/@3@4@.jpg", False),
    ]


def test_eval_lookup(spark, folder):
    df = spark.createDataFrame([(0, "a", True, 1.0, 2.0, None)], "image_id long, image_path string, is_query boolean, utm_east double, utm_north double, matches array<long>")
    sinks.save_test(df, folder, "set")
    assert tables.load_eval(spark, folder, "set").first()["matches"] == []
    sinks.save_val(df.withColumn("image_id", F.lit(7).cast("long")), folder, "set")
    assert tables.load_eval(spark, folder, "set").first()["image_id"] == 7
    assert tables.load_test(spark, folder, "set").first()["image_id"] == 0
    with pytest.raises(FileNotFoundError, match="val/other.*test/other"):
        tables.load_eval(spark, folder, "other")
    with pytest.raises(FileNotFoundError):
        tables.load_train(spark, folder, "other")


def test_embedding_store_checks_ids(spark, folder):
    df = spark.createDataFrame([("a", [1.0, 2.0], "s"), ("b", [3.0, 4.0], "t")], "image_path string, embedding array<float>, source string")
    store = f"{folder}/store"
    sinks.save_image_embeddings(df, store)
    assert tables.load_embeddings(spark, store, "t").count() == 1
    with pytest.raises(DataCheckError, match="1 image paths"):
        tables.load_embeddings(spark, store, ids=spark.createDataFrame([("a",), ("z",)], "image_path string"))


def test_keyed_stage_depends_on_content_and_parameters(spark, folder):
    calls = []

    def step(df):
        calls.append(1)
        return df.withColumn("y", F.col("id") * 2)

    df = spark.range(10)
    for table, params in ((df, {"a": 1}), (df.orderBy(F.desc("id")), {"a": 1}), (df, {"a": 2}), (spark.range(9), {"a": 1}), (df, None), (df, None)):
        assert sinks.keyed_stage(table, "double", params, folder, step).count() == table.count()
    assert len(calls) == 5


METRICS = [
    ("r", 0, "test/msls/R@1", 0.74), ("r", 1, "test/msls/R@5", 0.83), ("r", 2, "test/pitts/R@1", 0.64),
    ("r", 3, "test/loss", 1.5), ("r", 4, "test/msls/R@1", 0.1),
]


def test_recall_report(spark, folder):
    results = spark.createDataFrame(METRICS, "run string, seq int, name string, value double")
    path = sinks.save_recall_report(results, f"{folder}/report")
    got = {(r["dataset"], r["metric"]): round(r["value"], 9) for r in tables.load_metrics(spark, path).collect()}
    assert got == {
        ("msls", "R@1"): 0.74, ("msls", "R@5"): 0.83, ("pitts", "R@1"): 0.64,
        ("average", "R@1"): 0.69, ("average", "R@5"): 0.83,
    }
    shown = {r["dataset"]: (r["R@1"], r["R@5"]) for r in report.recall_table(report.recall_report(results), ["R@1", "R@5"]).collect()}
    assert shown == {"msls": ("74.0", "83.0"), "pitts": ("64.0", "-"), "average": ("69.0", "83.0")}
    assert sinks.save_recall_report(results.filter("name = 'test/loss'"), f"{folder}/none") is None
    assert not os.path.exists(f"{folder}/none")


def constant(value):
    return lambda: lambda paths: np.full((len(paths), 2), value)


def image_rows(spark, numbers):
    return spark.createDataFrame([(f"img_{n}", "s") for n in numbers], "image_path string, source string")


def test_only_missing_images_are_embedded(spark, folder):
    store = f"{folder}/store"
    embed.embed_missing(image_rows(spark, [1, 2]), store, "s", constant(1.0))
    embed.embed_missing(image_rows(spark, [1, 2, 3, 4, 4]), store, "s", constant(2.0))
    got = sorted((r["image_path"], r["embedding"][0]) for r in spark.read.parquet(store).collect())
    assert got == [("img_1", 1.0), ("img_2", 1.0), ("img_3", 2.0), ("img_4", 2.0)]
    assert embed.missing_images(image_rows(spark, [1]), None, "s").count() == 1


def test_stream_resumes_after_a_crash(spark, folder):
    feed, store, checkpoint = (f"{folder}/{x}" for x in ("feed", "store", "checkpoint"))
    schema = "image_path string, source string"
    for n in (1, 3):
        image_rows(spark, [n, n + 1]).coalesce(1).write.mode("append").parquet(feed)

    def fail_on_three(todo):
        if todo.filter("image_path = 'img_3'").count():
            raise RuntimeError("stop after first batch")
        return embed.apply_model(todo, constant(1.0))

    def stream():
        return embed_stream.manifest_stream(spark, feed, schema, files_per_batch=1)

    with pytest.raises(Exception, match="stop after first batch"):
        embed_stream.embed_stream(stream(), store, checkpoint, constant(1.0), transform=fail_on_three).awaitTermination()
    assert sorted(r["image_path"] for r in spark.read.parquet(store).collect()) == ["img_1", "img_2"]
    embed_stream.embed_stream(stream(), store, checkpoint, constant(2.0)).awaitTermination()
    got = sorted((r["image_path"], r["embedding"][0]) for r in spark.read.parquet(store).collect())
    assert got == [("img_1", 1.0), ("img_2", 1.0), ("img_3", 2.0), ("img_4", 2.0)]
