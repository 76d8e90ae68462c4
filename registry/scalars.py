"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocurate.functions import geo
from geocurate.functions import names as N
from geocurate.functions import vectors as V
from geocurate.operators import checks, places
from registry import query
from registry import views as W

NAME_SQL = (
    "'@' || CAST(utm_east AS VARCHAR) || '@' || CASE WHEN image_id % 11 = 0 THEN 'north' "
    "ELSE CAST(utm_north AS VARCHAR) END || '@10@S@' || '37.5@-122.1@pano' || CAST(image_id AS VARCHAR) || '@'"
    " || CAST(image_id % 9 AS VARCHAR) || '@' || CASE WHEN image_id % 13 = 0 THEN ' ' "
    "ELSE CAST(heading AS VARCHAR) END || '@@@@20170417@day@.jpg'"
)
PITTS_SQL = (
    "'@' || CAST(utm_east AS VARCHAR) || '@' || CAST(utm_north AS VARCHAR) || '@10@S@37.5@-122.1@pano'"
    " || CAST(image_id AS VARCHAR) || '@' || CASE WHEN image_id % 5 = 0 THEN '' ELSE CAST(image_id % 9 AS VARCHAR) END"
    " || '@@@@@@pitch' || CAST(image_id % 2 + 1 AS VARCHAR) || '_yaw' || CAST(image_id % {yaws} + 1 AS VARCHAR)"
    " || '@.jpg'"
)


def text(column: str):
    return F.col(column).cast("string")


def lenient_name():
    """``@``-names with some unreadable positions and blank headings."""
    i = F.col("image_id")
    return F.concat(
        F.lit("@"), text("utm_east"), F.lit("@"),
        F.when(i % 11 == 0, F.lit("north")).otherwise(text("utm_north")),
        F.lit("@10@S@37.5@-122.1@pano"), text("image_id"), F.lit("@"), (i % 9).cast("string"), F.lit("@"),
        F.when(i % 13 == 0, F.lit(" ")).otherwise(text("heading")), F.lit("@@@@20170417@day@.jpg"),
    )


def pitts_name(yaws: int = 12):
    i = F.col("image_id")
    return F.concat(
        F.lit("@"), text("utm_east"), F.lit("@"), text("utm_north"), F.lit("@10@S@37.5@-122.1@pano"),
        text("image_id"), F.lit("@"), F.when(i % 5 == 0, F.lit("")).otherwise((i % 9).cast("string")),
        F.lit("@@@@@@pitch"), (i % 2 + 1).cast("string"), F.lit("_yaw"), (i % yaws + 1).cast("string"),
        F.lit("@.jpg"),
    )


@query(
    "lenient_names",
    W.ctes(W.SHOTS)
    + """SELECT image_id, utm_east AS east, CASE WHEN image_id % 11 = 0 THEN NULL ELSE utm_north END AS north,
    CASE WHEN image_id % 13 = 0 THEN NULL ELSE heading END AS angle FROM shots""",
)
def lenient_names(spark, sf):
    named = W.shots(spark, sf).select("image_id", N.lenient_position(lenient_name()).alias("p"))
    return named.select(
        "image_id", F.col("p.utm_east").alias("east"), F.col("p.utm_north").alias("north"),
        F.col("p.heading").alias("angle"),
    )


@query(
    "strict_names",
    W.ctes(W.SHOTS)
    + """SELECT image_id, utm_east, utm_north, CAST((image_id % 12) * 30 AS DOUBLE) AS heading,
    CAST(image_id % 2 + 1 AS INTEGER) AS pitch_index, CAST(image_id % 12 + 1 AS INTEGER) AS yaw_index,
    CASE WHEN image_id % 5 = 0 THEN NULL ELSE CAST(image_id % 9 AS INTEGER) END AS tile_num,
    'pano' || CAST(image_id AS VARCHAR) AS pano_id FROM shots""",
)
def strict_names(spark, sf):
    named = W.shots(spark, sf).select("image_id", pitts_name().alias("name"))
    return named.select("image_id", N.strict_pitts(F.col("name")).alias("p")).select("image_id", "p.*").drop("problem")


@query(
    "relative_paths",
    W.ctes(W.SHOTS)
    + """SELECT image_id, CASE WHEN image_id % 3 = 2 THEN '/other/' || image_path ELSE image_path END AS path FROM shots""",
)
def relative_paths(spark, sf):
    roots = F.element_at(F.array(F.lit("/raw/"), F.lit("/data/set/"), F.lit("/other/")), (F.col("image_id") % 3 + 1).cast("int"))
    full = W.shots(spark, sf).select("image_id", F.concat(roots, "image_path").alias("full"))
    return full.select("image_id", N.relative_path(F.col("full"), "/raw", "/data/set").alias("path"))


UTM_SQL = """
utm0 AS (SELECT image_id, (utm_east - 551000e0) / 25e0 - 35e0 AS lat, (utm_north - 4180000e0) / 6e0 - 165e0 AS lon FROM shots),
utm1 AS (SELECT *, radians(lat) AS phi, CAST(trunc((lon + 180e0) / 6e0) AS INTEGER) + 1 AS zone,
  0.0033528106647474805e0 * (2e0 - 0.0033528106647474805e0) AS e2 FROM utm0),
utm2 AS (SELECT *, e2 / (1e0 - e2) AS ep2, tan(phi) * tan(phi) AS t,
  e2 / (1e0 - e2) * cos(phi) * cos(phi) AS c,
  cos(phi) * (radians(lon) - radians(CAST((zone - 1) * 6 - 177 AS DOUBLE))) AS a,
  6378137e0 / sqrt(1e0 - e2 * sin(phi) * sin(phi)) AS nu,
  6378137e0 * ((1e0 - e2/4e0 - 3e0*e2*e2/64e0 - 5e0*e2*e2*e2/256e0) * phi
    - (3e0*e2/8e0 + 3e0*e2*e2/32e0 + 45e0*e2*e2*e2/1024e0) * sin(2e0*phi)
    + (15e0*e2*e2/256e0 + 45e0*e2*e2*e2/1024e0) * sin(4e0*phi)
    - (35e0*e2*e2*e2/3072e0) * sin(6e0*phi)) AS m FROM utm1)"""


@query(
    "utm_positions",
    W.ctes(W.SHOTS, UTM_SQL)
    + """SELECT image_id, CAST(zone AS INTEGER) AS zone,
    CAST(round(0.9996e0 * nu * (a + (1e0 - t + c) * pow(a,3)/6e0
      + (5e0 - 18e0*t + t*t + 72e0*c - 58e0*ep2) * pow(a,5)/120e0) + 500000e0) AS BIGINT) AS east,
    CAST(round(0.9996e0 * (m + nu * tan(phi) * (pow(a,2)/2e0 + (5e0 - t + 9e0*c + 4e0*c*c) * pow(a,4)/24e0
      + (61e0 - 58e0*t + t*t + 600e0*c - 330e0*ep2) * pow(a,6)/720e0))
      + CASE WHEN lat < 0 THEN 10000000e0 ELSE 0e0 END) AS BIGINT) AS north FROM utm2""",
)
def utm_positions(spark, sf):
    at = W.shots(spark, sf).select(
        "image_id", ((F.col("utm_east") - W.EAST0) / 25.0 - 35.0).alias("lat"),
        ((F.col("utm_north") - W.NORTH0) / 6.0 - 165.0).alias("lon"),
    )
    east, north = geo.utm(F.col("lat"), F.col("lon"))
    return at.select(
        "image_id", geo.utm_zone(F.col("lon")).alias("zone"),
        F.round(east).cast("long").alias("east"), F.round(north).cast("long").alias("north"),
    )


@query(
    "city_image_paths",
    W.ctes(W.SHOTS)
    + """SELECT image_id, 'Images/' || source || '/' || source || '_' || lpad(CAST(image_id % 5000 AS VARCHAR), 7, '0')
    || '_' || CAST(2010 + image_id % 10 AS VARCHAR) || '_' || lpad(CAST(image_id % 12 + 1 AS VARCHAR), 2, '0')
    || '_' || lpad(CAST(CAST(heading AS INTEGER) AS VARCHAR), 3, '0') || '_' || CAST(utm_east / 16384e0 AS VARCHAR)
    || '_' || CAST(CASE WHEN image_id % 4 = 0 THEN (image_id % 100 - 50) / 100000e0 ELSE -utm_north / 65536e0 END AS VARCHAR) || '_pano' || CAST(image_id AS VARCHAR) || '.jpg' AS path FROM shots""",
)
def city_image_paths(spark, sf):
    """Positions as they are, and every fourth one near the meridian of Greenwich."""
    i = F.col("image_id")
    lon = F.when(i % 4 == 0, (i % 100 - 50) / F.lit(100000.0)).otherwise(-F.col("utm_north") / 65536.0)
    return W.shots(spark, sf).select(
        "image_id",
        N.city_image_path(
            F.col("source"), i % 5000, (2010 + i % 10).cast("int"), (i % 12 + 1).cast("int"),
            F.col("heading").cast("int"), F.col("utm_east") / 16384.0, lon,
            F.concat(F.lit("pano"), i.cast("string")),
        ).alias("path"),
    )


@query(
    "view_place_bins",
    W.ctes(W.SHOTS)
    + """SELECT image_id, CAST(floor(utm_east / 15e0) AS BIGINT) AS east_bin, CAST(floor(utm_north / 15e0) AS BIGINT) AS north_bin,
    CAST(floor(((heading * 2e0) % 360e0) / 60e0) AS BIGINT) AS heading_bin FROM shots""",
)
def view_place_bins(spark, sf):
    return W.shots(spark, sf).select(
        "image_id", geo.cell(F.col("utm_east"), 15).alias("east_bin"),
        geo.cell(F.col("utm_north"), 15).alias("north_bin"),
        geo.wrapped_heading_bucket(F.col("heading") * 2, 60).alias("heading_bin"),
    )


@query(
    "grid_cells",
    W.ctes(W.SHOTS)
    + """SELECT image_id, CAST(floor(utm_east / 12.5e0) AS BIGINT) AS cell_x, CAST(floor(utm_north / 12.5e0) AS BIGINT) AS cell_y,
    CAST(floor(heading * 2e0 / 60e0) AS BIGINT) AS cell_h FROM shots""",
)
def grid_cells(spark, sf):
    doubled = W.shots(spark, sf).withColumn("heading", F.col("heading") * 2)
    return places.add_cells(doubled, 12.5, 60.0).select("image_id", "cell_x", "cell_y", "cell_h")


@query(
    "linear_place_keys",
    W.ctes(W.SHOTS, W.placed("shots")) + "SELECT image_id, place_id FROM shots_placed",
)
def linear_place_keys(spark, sf):
    cells = places.add_cells(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)
    return places.linear_place_key(cells).select("image_id", "place_id")


@query(
    "flat_place_keys",
    W.ctes(W.SHOTS, W.placed("shots"))
    + "SELECT image_id, cell_x * (SELECT max(cell_y) + 1 FROM shots_cells) + cell_y AS place_id FROM shots_placed",
)
def flat_place_keys(spark, sf):
    cells = places.add_cells(W.shots(spark, sf), W.CELL_M)
    return places.linear_place_key(cells, use_heading=False).select("image_id", "place_id")


@query(
    "cell_backfill",
    W.ctes(W.SHOTS)
    + """SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 7 ELSE CAST(floor(utm_east / 50e0) AS BIGINT) END AS cell_x,
    CAST(floor(utm_north / 50e0) AS BIGINT) AS cell_y FROM shots""",
)
def cell_backfill(spark, sf):
    partly = W.shots(spark, sf).withColumn("cell_x", F.when(F.col("image_id") % 3 == 0, F.lit(7).cast("long")))
    return places.add_cells(partly, W.CELL_M).select("image_id", "cell_x", "cell_y")


@query(
    "coarse_tiles",
    W.ctes(W.SHOTS)
    + """SELECT CAST(floor(utm_east / 100e0) AS BIGINT) AS tile_x, CAST(floor(utm_north / 100e0) AS BIGINT) AS tile_y,
    count(*) AS num_images FROM shots GROUP BY 1, 2""",
)
def coarse_tiles(spark, sf):
    return W.shots(spark, sf).groupBy(
        geo.cell(F.col("utm_east"), 100).alias("tile_x"), geo.cell(F.col("utm_north"), 100).alias("tile_y")
    ).agg(F.count("*").alias("num_images"))


@query(
    "outer_group_numbers",
    W.ctes(W.SHOTS)
    + """SELECT image_id, ((x % 5 + 5) % 5) * 10 + ((y % 5 + 5) % 5) * 2 + h % 2 AS outer_group FROM (
    SELECT image_id, CAST(floor((utm_east - 552000e0) / 50e0) AS BIGINT) AS x, CAST(floor((utm_north - 4181000e0) / 50e0) AS BIGINT) AS y,
    CAST(floor(heading / 30e0) AS BIGINT) AS h FROM shots)""",
)
def outer_group_numbers(spark, sf):
    x = geo.cell(F.col("utm_east") - 552000.0, 50)
    y = geo.cell(F.col("utm_north") - 4181000.0, 50)
    return W.shots(spark, sf).select(
        "image_id", geo.outer_group(x, y, geo.heading_bucket(F.col("heading"), 30), 5, 2).alias("outer_group")
    )


@query(
    "unit_vectors",
    """WITH raw AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n, embedding FROM embeddings)
    SELECT vec_id, unnest(range(64)) AS dim, round(unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3e0 / (3e0 * n))), 6) AS x FROM raw""",
)
def unit_vectors(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = W.table(spark, sf, "embeddings").select("vec_id", V.l2_normalize(tripled).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x")
    )


@query(
    "inner_products",
    """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def inner_products(spark, sf):
    left = W.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = W.table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return left.join(right, "vec_id").select("vec_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query(
    "positions_to_origin",
    W.ctes(W.SHOTS)
    + """SELECT image_id, round(sqrt((utm_east - 551000e0) * (utm_east - 551000e0) + (utm_north - 4180000e0) * (utm_north - 4180000e0)), 3) AS metres FROM shots""",
)
def positions_to_origin(spark, sf):
    metres = geo.distance(F.col("utm_east"), F.col("utm_north"), F.lit(W.EAST0), F.lit(W.NORTH0))
    return W.shots(spark, sf).select("image_id", F.round(metres, 3).alias("metres"))


@query(
    "sign_codes",
    """SELECT a.vec_id, CAST(len(list_filter(a.embedding, lambda x: x >= 0)) AS BIGINT) AS ones,
    CAST(list_sum(list_transform(range(1, 65), lambda k: CASE WHEN (a.embedding[k] >= 0) <> (b.embedding[k] >= 0) THEN 1 ELSE 0 END)) AS BIGINT) AS differing
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def sign_codes(spark, sf):
    coded = W.table(spark, sf, "embeddings").select("vec_id", V.sign_code(F.col("embedding"), 64).alias("a"))
    following = coded.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return coded.join(following, "vec_id").select(
        "vec_id", F.bit_count(F.col("a")[0]).cast("long").alias("ones"),
        V.hamming(F.col("a"), F.col("b")).cast("long").alias("differing"),
    )


@query(
    "metric_names",
    W.ctes(W.METRIC)
    + """SELECT seq, replace(regexp_extract(name, '^(.*)/[^/]*$', 1), 'test/', '') AS dataset,
    regexp_extract(name, '([^/]*)$', 1) AS metric, contains(name, '/R@') AS is_recall FROM metric""",
)
def metric_names(spark, sf):
    name = F.col("name")
    return W.metric_results(spark, sf).select(
        "seq", N.metric_dataset(name).alias("dataset"), N.metric_label(name).alias("metric"),
        N.is_recall_metric(name).alias("is_recall"),
    )


@query(
    "percent_texts",
    W.ctes(W.METRIC)
    + """SELECT seq, format('{:.1f}', CASE WHEN contains(name, '/R@') THEN value * 100 ELSE value END) AS shown FROM metric""",
)
def percent_texts(spark, sf):
    return W.metric_results(spark, sf).select("seq", N.percent_text(F.col("name"), F.col("value")).alias("shown"))


@query(
    "uniform_supergroups",
    W.ctes(W.SHOTS) + "SELECT image_id, CAST(0 AS BIGINT) AS supergroup_id FROM shots",
)
def uniform_supergroups(spark, sf):
    return places.uniform_supergroup(W.shots(spark, sf)).select("image_id", "supergroup_id")


# -- checks, shown as the rows or counts they find ----------------------------


@query(
    "missing_headings",
    W.ctes(W.SHOTS) + "SELECT count(*) FILTER (image_id % 13 = 0) AS missing, count(*) AS total FROM shots",
)
def missing_headings(spark, sf):
    parsed = W.shots(spark, sf).select(N.lenient_position(lenient_name()).alias("p")).select("p.heading")
    return checks.missing_heading_count(parsed)


@query(
    "missing_vectors",
    W.ctes(W.SHOTS) + "SELECT DISTINCT image_id AS vec_id FROM shots WHERE image_id NOT IN (SELECT vec_id FROM embeddings)",
)
def missing_vectors(spark, sf):
    images = W.shots(spark, sf).select(F.col("image_id").alias("vec_id"))
    return checks.missing_keys(images, W.table(spark, sf, "embeddings"), ["vec_id"])


@query(
    "malformed_view_names",
    W.ctes(W.SHOTS) + "SELECT image_id, 'yaw out of range' AS problem FROM shots WHERE image_id % 15 >= 12",
)
def malformed_view_names(spark, sf):
    named = W.shots(spark, sf).select("image_id", N.strict_pitts(pitts_name(15)).alias("p"))
    return named.select("image_id", "p.problem").filter(F.col("problem").isNotNull())


@query(
    "smallest_place",
    W.ctes(W.SHOTS, W.placed("shots"))
    + "SELECT min(n) AS smallest FROM (SELECT place_id, count(*) AS n FROM shots_placed GROUP BY 1)",
)
def smallest_place(spark, sf):
    placed = places.assign_places(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)
    return places.place_sizes(placed).agg(F.min("num_images").alias("smallest"))
