"""Inputs that a silent join or parse would thin out: they fail with a count, or keep every row."""

import os

import pytest
from pyspark.sql import functions as F

from geocurate.operators import embed, ids, places
from geocurate.operators.checks import DataCheckError
from geocurate.plans import curation
from geocurate.sources import images, listing, sinks, tables

PARAMS = curation.CurationParams(tau=-1.0, min_images=1, supergroup_size=None)


def manifest(spark, n=10):
    rows = [(i, f"p{i}", 5.0 * i, 1.0, 10.0, "s") for i in range(n)]
    return spark.createDataFrame(
        rows, "image_id long, image_path string, utm_east double, utm_north double, heading double, source string"
    )


def store(spark, paths):
    rows = [("s", p, [1.0, 0.5]) for p in paths]
    return spark.createDataFrame(rows, "source string, image_path string, embedding array<float>")


def test_curation_keeps_every_image_or_fails(spark):
    frame = manifest(spark)
    whole = store(spark, [f"p{i}" for i in range(10)])
    assert curation.curate(frame, whole, PARAMS).images.count() == 10
    with pytest.raises(DataCheckError, match="of 10 images 1 have no vector, 0 have several"):
        curation.curate(frame, whole.filter("image_path <> 'p3'"), PARAMS)
    with pytest.raises(DataCheckError, match="0 have no vector, 2 have several"):
        embed.attach(frame, whole.union(store(spark, ["p1", "p2"])))


def test_positions_are_required_where_no_cell_is_given(spark):
    lost = manifest(spark).selectExpr(
        "image_id", "image_path", "if(image_id = 2, null, utm_east) AS utm_east",
        "if(image_id = 4, double('NaN'), utm_north) AS utm_north", "heading", "source",
    )
    with pytest.raises(DataCheckError, match="2 of 10 images are missing a position"):
        places.assign_places(lost, 12.5, 60.0)
    given = lost.selectExpr("*", "if(image_id IN (2, 4), 1L, null) AS cell_x", "if(image_id IN (2, 4), 1L, null) AS cell_y")
    assert places.assign_places(given, 12.5, 60.0).filter("place_id IS NOT NULL").count() == 10


def test_codes_of_null_keys(spark):
    frame = spark.createDataFrame([("a", 1), (None, 1), (None, None), ("a", 1)], "source string, place_id long")
    coded = ids.factorize(frame, ["source", "place_id"], "code")
    assert sorted(r.code for r in coded.collect()) == [0, 1, 2, 2]
    assert places.factorize_sources(frame).count() == 4


def test_evaluation_needs_all_vectors(spark):
    matched = spark.createDataFrame(
        [(0, True, [2]), (1, True, [2]), (2, False, [])], "image_id long, is_query boolean, matches array<long>"
    )
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0])], "image_id long, embedding array<double>")
    with pytest.raises(DataCheckError, match="1 have no vector"):
        curation.evaluate(matched, vectors)


def test_scan_finds_every_name(spark, folder):
    names = ["a.jpg", "_b.jpg", ".c.png", "_d/e.jpg", ".f/g/h.JPG", "x/_y/.z.webp", "x/y.txt", "k=1/_i.jpg", "_x=1.png", "_metadata.jpg", "x/a b#c%20.jpg"]
    for name in names:
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(b"0")
    found = [r.path.removeprefix(folder + "/") for r in images.scan_images(spark, [folder]).collect()]
    want = sorted(n for n in names if not n.endswith(".txt"))
    assert sorted(found) == want
    by_spark = listing._listed_by_spark(spark, [(0, folder)]).filter("path NOT LIKE '%.txt'").collect()
    assert sorted(r.path.removeprefix(folder + "/") for r in by_spark) == want and {r.length for r in by_spark} == {1}
    roots = [f"{folder}/x", f"{folder}/x", f"{folder}/_d"]
    assert sorted((r.root, r.path.rsplit("/", 1)[1]) for r in images.scan_images(spark, roots).collect()) == [
        (0, ".z.webp"), (0, "a b#c%20.jpg"), (1, ".z.webp"), (1, "a b#c%20.jpg"), (2, "e.jpg")
    ]
    os.makedirs(f"{folder}/empty/er")
    assert images.scan_images(spark, [f"{folder}/empty"]).count() == 0


def test_manifest_follows_its_files(spark, folder):
    def put(name, content=b"0"):
        os.makedirs(os.path.dirname(f"{folder}/raw/{name}"), exist_ok=True)
        with open(f"{folder}/raw/{name}", "wb") as file:
            file.write(content)

    parsed = []

    def parse(files):
        parsed.append(files.count())
        return files.withColumn("name", F.element_at(F.split("path", "/"), -1))

    def update():
        rows, counts = sinks.updated_manifest(images.list_images(spark, [f"{folder}/raw"]), f"{folder}/manifest", parse)
        numbered = images.in_walk_order(rows.select("root", "path", "name"))
        return [r.name for r in numbered.orderBy("image_id").collect()], counts

    for name in ("a/1.jpg", "a/_2.jpg", "b/3.jpg"):
        put(name)
    assert update() == (["1.jpg", "_2.jpg", "3.jpg"], {"kept": 0, "parsed": 3, "removed": 0})
    assert update() == (["1.jpg", "_2.jpg", "3.jpg"], {"kept": 3, "parsed": 0, "removed": 0})
    put("a/15.jpg")
    put("b/3.jpg", b"longer")
    os.remove(f"{folder}/raw/a/1.jpg")
    assert update() == (["15.jpg", "_2.jpg", "3.jpg"], {"kept": 1, "parsed": 2, "removed": 1})
    assert parsed == [3, 2]


def test_saving_a_loaded_set_keeps_its_rows(spark, folder):
    frame = spark.createDataFrame(
        [(0, 7, 0), (1, 8, 0), (2, 7, 1), (3, 9, 1)], "image_id long, place_id long, supergroup_id long"
    )
    sinks.save_train(frame, folder, "one")
    sinks.save_train(tables.load_train(spark, folder, "one"), folder, "two")
    assert tables.load_train(spark, folder, "two").count() == 4


def test_plans_leave_only_their_results(spark):
    from geocurate import runtime

    before = set(runtime._created)
    frame, whole = manifest(spark), store(spark, [f"p{i}" for i in range(10)])
    for tau in (-1.0, 0.3):
        curation.curate(frame, whole, curation.CurationParams(tau=tau, min_images=1, supergroup_size=None))
    assert len(set(runtime._created) - before) == 4


def test_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from geocurate import runtime

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session)


def test_tiles_need_positions(spark):
    lost = manifest(spark).withColumn("utm_east", F.when(F.col("image_id") != 3, F.col("utm_east")))
    with pytest.raises(DataCheckError, match="1 of 10 images have no position"):
        places.subsample_tiles(lost, 0.5)


def test_equal_paths_of_two_sources(spark, folder):
    store = spark.createDataFrame([("p", [1.0], "a"), ("p", [2.0], "b"), ("q", [3.0], "a")], "image_path string, embedding array<float>, source string")
    sinks.save_image_embeddings(store, f"{folder}/store")
    named = spark.createDataFrame([("p", "b"), ("q", "a"), ("q", "a")], "image_path string, source string")
    got = tables.load_embeddings(spark, f"{folder}/store", ids=named).collect()
    assert sorted((r.image_path, r.embedding) for r in got) == [("p", [2.0]), ("q", [3.0])]
    with pytest.raises(DataCheckError, match="1 image paths belong to several sources"):
        tables.load_embeddings(spark, f"{folder}/store", ids=named.select("image_path"))
    assert tables.load_embeddings(spark, f"{folder}/store", "a", named.select("image_path")).count() == 2


def test_an_updated_manifest_reads_its_listing_once(spark, folder):
    """The listing is joined with the stored rows once, and unchanged files are not written again."""
    before = spark.range(40).select(
        F.lit(0).alias("root"), F.format_string("a/%03d.jpg", "id").alias("path"), F.col("id").alias("length"), F.timestamp_seconds("id").alias("modified")
    )
    seen = spark.sparkContext.accumulator(0)

    def watched(df):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return df.mapInArrow(count, df.schema)

    parse = lambda files: files.withColumn("name", F.upper("path"))
    sinks.updated_manifest(before, folder, parse)
    now = before.filter("length >= 5").withColumn("length", F.when(F.col("length") < 9, -1).otherwise(F.col("length")))
    rows, counts = sinks.updated_manifest(watched(now), folder, parse)
    assert counts == {"kept": 31, "parsed": 4, "removed": 5}
    assert sorted((r.path, r.length, r.name) for r in rows.collect()) == sorted((r.path, r.length, r.path.upper()) for r in now.collect())
    assert seen.value == 35


def test_only_what_a_number_needs_is_sorted(spark, monkeypatch):
    """Paths and positions of city lines, and the walk keys of files, are not written with the order."""
    from geocurate.sources import cities

    written, stage = [], ids.stage
    monkeypatch.setattr(ids, "stage", lambda df, label: written.append(df.columns) or stage(df, label))
    rows = spark.createDataFrame(
        [("Rome", 7, 2019, 5, 90, 41.9, 12.5, "p1", "Rome", 0, 1), ("Oslo", 3, 2018, 11, 5, 59.9, 10.7, "p0", "Oslo", 0, 0)],
        "city_id string, place_id long, year int, month int, northdeg int, lat double, lon double, panoid string, file_city string, block long, line long",
    )
    got = cities.city_manifest(rows, cities.city_ordinals(rows, None)).orderBy("image_id").collect()
    assert [(r.image_id, r.place_id, r.heading) for r in got] == [(0, 3, 5.0), (1, 100007, 90.0)]
    assert [r.image_path.split("/")[-1].split("_")[0] for r in got] == ["Oslo", "Rome"]
    assert not {"image_path", "utm_east"} & set(written[0])
    files = spark.createDataFrame([(0, "/r/b/1.jpg"), (0, "/r/a.jpg"), (0, "/r/a/2.jpg")], "root int, path string")
    walked = images.in_walk_order(files)
    assert walked.columns == ["root", "path", "image_id"] and "_walk" not in written[-1]
    assert [r.path for r in walked.orderBy("image_id").collect()] == [r.path for r in images.in_walk_order(walked.repartition(3)).orderBy("image_id").collect()]
