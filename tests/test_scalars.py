"""Literal cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from geocurate.functions import geo
from geocurate.functions import names as N
from geocurate.functions import vectors as V


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("@0398171.26@3702024.63@12@S@033.45281@-112.09566@pano@@359@@@@20170417@day@.jpg", (398171.26, 3702024.63, 359.0)),
        ("@a@2@.jpg", (None, 2.0, None)),
        ("1@ 2 @3.jpeg", (1.0, 2.0, None)),
        ("@1e3@-2.5@@@@@@@ @.png", (1000.0, -2.5, None)),
        ("plain.jpg", (None, None, None)),
        ("@1d@0x10@.jpg", (None, None, None)),
    ],
)
def test_lenient_position(spark, name, want):
    p = one(spark, N.lenient_position(F.lit(name)).alias("p"))["p"]
    assert (p["utm_east"], p["utm_north"], p["heading"]) == want


@pytest.mark.parametrize(
    ("note", "heading", "problem"),
    [
        ("pitch1_yaw7", 180.0, None),
        ("PITCH2_YAW1", 0.0, None),
        ("pitch1_yaw13", 360.0, "yaw out of range"),
        ("pitch1_yaw0", -30.0, "yaw out of range"),
        ("foo", None, "pitch and yaw not found"),
        ("pitch1_yaw7x", None, "pitch and yaw not found"),
    ],
)
def test_strict_pitts_note(spark, note, heading, problem):
    name = f"@1@2@10@S@3@4@pano9@5@@@@@@{note}@.jpg"
    p = one(spark, N.strict_pitts(F.lit(name)).alias("p"))["p"]
    assert p["problem"] == problem
    assert p["heading"] == heading
    assert (p["pano_id"], p["tile_num"]) == ("pano9", 5)


def test_strict_pitts_fields(spark):
    short = one(spark, N.strict_pitts(F.lit("@1@2@.jpg")).alias("p"))["p"]
    assert short["problem"] == "too few fields"
    blank = one(spark, N.strict_pitts(F.lit("@1@2@10@S@3@4@p@@@@@@@pitch1_yaw2@.jpg")).alias("p"))["p"]
    assert blank["problem"] is None and blank["tile_num"] is None


@pytest.mark.parametrize(
    ("path", "ok"), [("a/b.JPG", True), ("a/b.webp", True), ("a.jpg/b", False), ("a/b.txt", False), ("x.jpeg", True), ("d/.jpg", False)]
)
def test_image_extension(spark, path, ok):
    assert one(spark, N.has_image_extension(F.lit(path)).alias("x"))["x"] is ok


def test_walk_order(spark):
    paths = ["/r/b/1.jpg", "/r/a.jpg", "/r/z.jpg", "/r/b!/0.jpg", "/r/b/c/0.jpg", "/r/a/9.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").orderBy(N.walk_key(F.col("path")))
    assert [r["path"] for r in df.collect()] == [
        "/r/a.jpg", "/r/z.jpg", "/r/a/9.jpg", "/r/b/1.jpg", "/r/b/c/0.jpg", "/r/b!/0.jpg",
    ]


def test_utm_known_positions(spark):
    # Statue of Liberty and Sydney Opera House, published UTM coordinates
    east, north = geo.utm(F.lit(40.689247), F.lit(-74.044502))
    row = one(spark, east.alias("e"), north.alias("n"))
    assert abs(row["e"] - 580735.8) < 2 and abs(row["n"] - 4504698.8) < 10
    east, north = geo.utm(F.lit(0.0), F.lit(3.0))
    row = one(spark, east.alias("e"), north.alias("n"), geo.utm_zone(F.lit(180.0)).alias("z"))
    assert abs(row["e"] - 500000) < 1e-6 and abs(row["n"]) < 1e-6 and row["z"] == 61


def test_cells_and_headings(spark):
    row = one(
        spark,
        geo.heading_bucket(F.lit(360.0), 60).alias("a"), geo.wrapped_heading_bucket(F.lit(360.0), 60).alias("b"),
        geo.outer_group(F.lit(-1).cast("long"), F.lit(0).cast("long"), None, 5, 2).alias("g"),
        geo.cell(F.lit(-0.5), 1).alias("c"),
    )
    assert (row["a"], row["b"], row["g"], row["c"]) == (6, 0, 20, -1)


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = one(
        spark, V.l2_normalize(v).alias("u"), V.l2_normalize(zero).alias("z"), V.l2_normalize(zero, 1e-8).alias("f"),
        V.cosine(v, v).alias("c"), V.sign_vector(F.array(F.lit(-1.0), F.lit(0.0))).alias("s"),
    )
    assert row["u"] == [0.6, 0.8] and row["z"] == [0.0, 0.0] and row["f"] == [0.0, 0.0]
    assert math.isclose(row["c"], 1.0) and row["s"] == [-1, 1]


def test_sign_code_and_hamming(spark):
    wide = F.array(*[F.lit(1.0 if i % 3 else -1.0) for i in range(130)])
    flipped = F.array(*[F.lit(-1.0 if i % 3 else 1.0) for i in range(130)])
    row = one(
        spark, V.sign_code(wide, 130).alias("a"),
        V.hamming(V.sign_code(wide, 130), V.sign_code(flipped, 130)).alias("d"),
    )
    assert len(row["a"]) == 3 and row["d"] == 130


def test_metric_text(spark):
    row = one(
        spark, N.percent_text(F.lit("test/a/R@1"), F.lit(0.741)).alias("a"), N.percent_text(F.lit("loss"), F.lit(6.25)).alias("b"),
        N.metric_dataset(F.lit("test/x/y/R@5")).alias("d"), N.metric_label(F.lit("test/x/y/R@5")).alias("m"),
    )
    assert tuple(row) == ("74.1", "6.2", "x/y", "R@5")
