"""Sources and sinks: data derived from the tables is written, then read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from geocurate import runtime
from geocurate.functions import names as N
from geocurate.operators import embed, matches, places, profile
from geocurate.sources import cities, images, sinks, tables
from geocurate.streaming import embed_stream
from registry import query
from registry import views as W
from registry.scalars import NAME_SQL, PITTS_SQL, lenient_name, pitts_name


def fresh(spark, label: str) -> str:
    return runtime.new_path(spark, label)


def _touch(paths) -> None:
    for row in paths:
        os.makedirs(os.path.dirname(row["path"]), exist_ok=True)
        with open(row["path"], "wb") as file:
            file.write(b"0")


def _write_tree(spark, sf) -> str:
    """One tiny image file per embedding; every second number lies one folder deeper."""
    root = fresh(spark, "tree").removeprefix("file:")
    i = F.col("image_id")
    folder = F.when(i % 3 == 1, "_sub").when(i % 3 == 2, ".sub").otherwise("sub")
    deeper = F.when(i % 2 == 0, F.concat(folder, (i % 3).cast("string"), F.lit("/"))).otherwise("")
    extension = F.when(i % 17 == 0, ".txt").when(i % 5 == 0, ".JPG").otherwise(".png")
    hidden = F.when(i % 7 == 0, "_").when(i % 11 == 0, ".").when(i % 13 == 0, "_x=").otherwise("")
    name = F.concat(F.lit(root + "/"), "source", F.lit("/"), deeper, hidden, F.lpad(i.cast("string"), 6, "0"), extension)
    W.img(spark, sf).select(name.alias("path")).foreachPartition(_touch)
    return root


@query(
    "image_tree_scan",
    W.ctes(
        W.IMG,
        """files AS (SELECT source, image_id % 2 = 0 AS deep, CASE WHEN image_id % 2 = 0 THEN CASE image_id % 3 WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END || 'sub' || CAST(image_id % 3 AS VARCHAR) ELSE '' END AS sub,
        CASE WHEN image_id % 7 = 0 THEN '_' WHEN image_id % 11 = 0 THEN '.' WHEN image_id % 13 = 0 THEN '_x=' ELSE '' END || lpad(CAST(image_id AS VARCHAR), 6, '0') || CASE WHEN image_id % 5 = 0 THEN '.JPG' ELSE '.png' END AS name
        FROM img WHERE image_id % 17 <> 0)""",
    )
    + """SELECT row_number() OVER (ORDER BY source, deep, sub, name) - 1 AS image_id,
    source || '/' || CASE WHEN deep THEN sub || '/' ELSE '' END || name AS path FROM files""",
)
def image_tree_scan(spark, sf):
    root = _write_tree(spark, sf)
    walked = images.in_walk_order(images.scan_images(spark, [root]))
    base = images.base_dirs(spark, root)
    return walked.select("image_id", N.relative_path(F.col("path"), *base).alias("path"))


def _named_paths(spark, sf):
    """Paths as a scan of two roots would list them."""
    return W.shots(spark, sf).select(
        (F.col("image_id") % 2).cast("int").alias("root"),
        F.concat(F.lit("/raw/"), "source", F.lit("/"), lenient_name()).alias("path"),
    )


def _named_sql(tag: str) -> str:
    return W.ctes(
        W.SHOTS,
        f"files AS (SELECT *, image_id % 2 AS root, source || '/' || {NAME_SQL} AS path FROM shots)",
    ) + f"""SELECT row_number() OVER (ORDER BY root, source, path) - 1 AS image_id, path AS image_path, utm_east,
    CASE WHEN image_id % 11 = 0 THEN NULL ELSE utm_north END AS utm_north,
    CASE WHEN image_id % 13 = 0 THEN NULL ELSE heading END AS heading, '{tag}' AS source FROM files"""


@query("sf_xl_manifest", _named_sql("sf_xl"))
def sf_xl_manifest(spark, sf):
    return images.named_manifest(_named_paths(spark, sf), "sf_xl", "/raw")


@query("msls_manifest", _named_sql("msls"))
def msls_manifest(spark, sf):
    return images.named_manifest(_named_paths(spark, sf), "msls", "/raw")


@query(
    "pitts_manifest",
    W.ctes(
        W.SHOTS,
        f"""files AS (SELECT *, {PITTS_SQL.format(yaws=12)} AS name, CAST((image_id % 12) * 30 AS DOUBLE) AS yaw_heading FROM shots),
        bins AS (SELECT *, floor(utm_east / 15e0) AS e, floor(utm_north / 15e0) AS n, floor(yaw_heading / 60e0) AS h FROM files)""",
    )
    + """SELECT row_number() OVER (ORDER BY source, name) - 1 AS image_id, source || '/' || name AS image_path, utm_east, utm_north,
    yaw_heading AS heading, CAST(image_id % 2 + 1 AS INTEGER) AS pitch_index, CAST(image_id % 12 + 1 AS INTEGER) AS yaw_index,
    CASE WHEN image_id % 5 = 0 THEN NULL ELSE CAST(image_id % 9 AS INTEGER) END AS tile_num, 'pano' || CAST(image_id AS VARCHAR) AS pano_id,
    'pitts30k' AS source, dense_rank() OVER (ORDER BY e, n, h) - 1 AS place_id FROM bins""",
)
def pitts_manifest(spark, sf):
    paths = W.shots(spark, sf).select(
        F.lit(0).alias("root"), F.concat(F.lit("/raw/"), "source", F.lit("/"), pitts_name()).alias("path")
    )
    return images.pitts_manifest(paths, "/raw")


def city_rows(spark, sf):
    """The lines of city CSVs: the source is the city, the image number the line."""
    i = F.col("image_id")
    return W.shots(spark, sf).select(
        F.col("source").alias("city_id"), (i % 5000).alias("place_id"),
        (2010 + i % 10).cast("int").alias("year"), (i % 12 + 1).cast("int").alias("month"),
        F.col("heading").cast("int").alias("northdeg"),
        ((F.col("utm_east") - W.EAST0) / 16384.0 + 37.0).alias("lat"),
        ((F.col("utm_north") - W.NORTH0) / 16384.0 - 122.0).alias("lon"),
        F.concat(F.lit("pano"), i.cast("string")).alias("panoid"),
        F.col("source").alias("file_city"), F.lit(0).alias("block"), i.alias("line"),
    )


@query(
    "city_manifest",
    W.ctes(
        W.SHOTS,
        """city AS (SELECT *, CASE source WHEN 'gsvcities' THEN 0 WHEN 'msls' THEN 1 ELSE 2 END AS ordinal,
        (utm_east - 551000e0) / 16384e0 + 37e0 AS lat, (utm_north - 4180000e0) / 16384e0 - 122e0 AS lon FROM shots WHERE source <> 'pitts30k')""",
    )
    + """SELECT row_number() OVER (ORDER BY ordinal, image_id) - 1 AS image_id, image_id % 5000 + ordinal * 100000 AS place_id,
    'Images/' || source || '/' || source || '_' || lpad(CAST(image_id % 5000 AS VARCHAR), 7, '0')
    || '_' || CAST(2010 + image_id % 10 AS VARCHAR) || '_' || lpad(CAST(image_id % 12 + 1 AS VARCHAR), 2, '0')
    || '_' || lpad(CAST(CAST(heading AS INTEGER) AS VARCHAR), 3, '0') || '_' || CAST(lat AS VARCHAR)
    || '_' || CAST(lon AS VARCHAR) || '_pano' || CAST(image_id AS VARCHAR) || '.jpg' AS image_path, heading FROM city""",
)
def city_manifest(spark, sf):
    rows = city_rows(spark, sf)
    ordinals = cities.city_ordinals(rows, ["sf_xl", "msls", "gsvcities"])
    return cities.city_manifest(rows, ordinals).select("image_id", "place_id", "image_path", "heading")


@query(
    "missing_cities",
    W.ctes(W.SHOTS)
    + "SELECT city FROM (VALUES ('atlantis'), ('msls'), ('utopia')) AS wanted(city) WHERE city NOT IN (SELECT source FROM shots)",
)
def missing_cities(spark, sf):
    available = W.shots(spark, sf).select(F.col("source").alias("city")).distinct()
    wanted = spark.createDataFrame([("atlantis",), ("msls",), ("utopia",)], "city string")
    return wanted.join(available, "city", "left_anti")


@query(
    "eval_manifest",
    W.ctes(
        W.SHOTS_EVAL,
        f"files AS (SELECT *, source || '/' || {NAME_SQL} AS path FROM shots_eval)",
    )
    + """SELECT row_number() OVER (ORDER BY is_query DESC, source, path) - 1 AS image_id, path AS image_path, is_query,
    utm_east, CASE WHEN image_id % 11 = 0 THEN NULL ELSE utm_north END AS utm_north FROM files""",
)
def eval_manifest(spark, sf):
    paths = W.shots_eval(spark, sf).select(
        F.when(F.col("is_query"), 0).otherwise(1).alias("root"),
        F.concat(F.lit("/raw/"), "source", F.lit("/"), lenient_name()).alias("path"),
    )
    return images.eval_manifest(paths, "/raw")


def grouped(spark, sf):
    """``shots`` on the 50 m grid, with the outer group as supergroup."""
    placed = places.assign_places(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)
    x, y, h = (F.col(c) for c in ("cell_x", "cell_y", "cell_h"))
    return placed.withColumn("supergroup_id", ((x % 2) * 2 + y % 2) * 2 + h % 2)


@query(
    "train_set_roundtrip",
    W.ctes(W.SHOTS, W.grouped("shots"))
    + """SELECT image_id, image_path, utm_east, utm_north, heading, source, supergroup_id,
    dense_rank() OVER (PARTITION BY supergroup_id ORDER BY place_id) - 1 AS place_id FROM shots_grouped""",
)
def train_set_roundtrip(spark, sf):
    root = fresh(spark, "processed")
    sinks.save_train(grouped(spark, sf), root, "grid")
    return tables.load_train(spark, root, "grid").drop("cell_x", "cell_y", "cell_h")


def _eval_sql(view: str, radius: int) -> str:
    near = f"""(d.utm_east - q.utm_east) * (d.utm_east - q.utm_east) + (d.utm_north - q.utm_north) * (d.utm_north - q.utm_north) <= {radius * radius}e0"""
    return f"""
    pairs AS (SELECT q.image_id AS query_id, d.image_id AS database_id FROM {view} q, {view} d
      WHERE q.is_query AND NOT d.is_query AND {near}),
    lists AS (SELECT query_id, string_agg(CAST(database_id AS VARCHAR), ',' ORDER BY database_id) AS matches FROM pairs GROUP BY 1)"""


MATCHES_SQL = _eval_sql


@query(
    "val_set_roundtrip",
    W.ctes(W.IMG_EVAL, _eval_sql("img_eval", 10))
    + """SELECT image_id, image_path, is_query, utm_east, utm_north, coalesce(matches, '') AS matches
    FROM img_eval LEFT JOIN lists ON query_id = image_id WHERE NOT is_query OR matches IS NOT NULL""",
)
def val_set_roundtrip(spark, sf):
    root = fresh(spark, "processed")
    manifest = W.img_eval(spark, sf).select("image_id", "image_path", "is_query", "utm_east", "utm_north")
    sinks.save_val(matches.add_matches(manifest, 10), root, "near")
    return _joined(tables.load_eval(spark, root, "near"))


@query(
    "test_set_roundtrip",
    W.ctes(W.IMG_EVAL)
    + "SELECT image_id, image_path, is_query, utm_east, utm_north, '' AS matches FROM img_eval",
)
def test_set_roundtrip(spark, sf):
    root = fresh(spark, "processed")
    manifest = W.img_eval(spark, sf).select(
        "image_id", "image_path", "is_query", "utm_east", "utm_north",
        F.lit(None).cast("array<long>").alias("matches"),
    )
    sinks.save_test(manifest, root, "plain")
    return _joined(tables.load_eval(spark, root, "plain"))


def _joined(df):
    return df.withColumn("matches", F.array_join("matches", ","))


@query(
    "embedding_store_roundtrip",
    W.ctes(W.IMG)
    + """SELECT image_path, source, len(embedding) AS dims, round(list_sum(embedding), 4) AS total FROM img
    WHERE source = 'msls'""",
)
def embedding_store_roundtrip(spark, sf):
    store = fresh(spark, "store")
    sinks.save_image_embeddings(W.img(spark, sf), store)
    ids = W.img(spark, sf).filter("source = 'msls'").select("image_path")
    read = tables.load_embeddings(spark, store, "msls", ids)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return read.select(
        "image_path", "source", F.size("embedding").cast("long").alias("dims"), F.round(total, 4).alias("total")
    )


@query(
    "place_store_roundtrip",
    W.ctes(W.IMG, W.placed("img"))
    + "SELECT place_id, 64 AS dims FROM img_placed GROUP BY place_id",
)
def place_store_roundtrip(spark, sf):
    from geocurate.operators.aggregate import place_embeddings

    store = fresh(spark, "places")
    placed = places.assign_places(W.img(spark, sf), W.CELL_M, W.HEADING_DEG)
    sinks.save_place_embeddings(place_embeddings(placed), store)
    return tables.load_place_embeddings(spark, store).select("place_id", F.size("embedding").alias("dims"))


FIRST_METRICS_SQL = W.METRIC + """,
firsts AS (SELECT run, name, arg_min(value, seq) AS value FROM metric GROUP BY 1, 2),
rows AS (SELECT run, regexp_extract(name, '^test/(.*)/[^/]*$', 1) AS dataset, regexp_extract(name, '([^/]*)$', 1) AS metric, value
  FROM firsts WHERE contains(name, '/R@')),
report AS (SELECT * FROM rows UNION ALL SELECT run, 'average', metric, avg(value) FROM rows GROUP BY run, metric)"""


@query(
    "metric_files",
    W.ctes(FIRST_METRICS_SQL) + "SELECT run, dataset, metric, round(value, 6) AS value FROM report",
)
def metric_files(spark, sf):
    path = sinks.save_recall_report(W.metric_results(spark, sf), fresh(spark, "report"))
    return tables.load_metrics(spark, path).withColumn("value", F.round("value", 6))


@query(
    "summary_file",
    W.ctes(W.SHOTS, W.placed("shots"))
    + """SELECT count(*) AS num_images, count(DISTINCT place_id) AS num_places,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM shots_placed GROUP BY place_id)) AS largest FROM shots_placed""",
)
def summary_file(spark, sf):
    root = fresh(spark, "processed")
    path = sinks.save_summary(profile.train_summary(grouped(spark, sf)), root, "train", "grid")
    return spark.read.json(path).select(
        "num_images", "num_places", F.col("images_per_place.max").alias("largest")
    )


@query(
    "keyed_stage",
    W.ctes(W.SHOTS, W.placed("shots")) + "SELECT place_id, count(*) AS num_images FROM shots_placed GROUP BY 1",
)
def keyed_stage(spark, sf):
    folder = fresh(spark, "stages")
    placed = places.assign_places(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)
    sinks.keyed_stage(placed, "place_sizes", {"cell": W.CELL_M}, folder, places.place_sizes)
    # the second call finds the stored result, whatever step it names
    return sinks.keyed_stage(placed, "place_sizes", {"cell": W.CELL_M}, folder, lambda df: df.limit(0))


@query(
    "keyed_manifest",
    W.ctes(W.SHOTS) + "SELECT source, count(*) AS num_images FROM shots GROUP BY 1",
)
def keyed_manifest(spark, sf):
    folder = fresh(spark, "stages")
    listing = W.shots(spark, sf).select("image_path", "source")
    return sinks.keyed_manifest(
        listing, "all", {"roots": ["/raw"]}, folder,
        lambda df: df.groupBy("source").agg(F.count("*").alias("num_images")),
    )


@query(
    "updated_manifest",
    W.ctes(W.SHOTS, f"files AS (SELECT *, source || '/' || {NAME_SQL} AS path FROM shots)")
    + """SELECT path, utm_east, CASE WHEN image_id % 10 IN (1, 2) THEN 2 ELSE 1 END AS parsed_in FROM files WHERE image_id % 10 <> 0""",
)
def updated_manifest(spark, sf):
    """A listing that is read again, then one with files removed, changed and added."""
    i = F.col("image_id")
    now = W.shots(spark, sf).select(
        F.lit(0).alias("root"), F.concat("source", F.lit("/"), lenient_name()).alias("path"), i.alias("length"),
        F.timestamp_seconds(F.when(i % 10 == 1, 200).otherwise(100)).alias("modified"), i,
    )
    before = now.filter(i % 10 != 2).withColumn("modified", F.timestamp_seconds(F.lit(100))).drop("image_id")
    folder = fresh(spark, "manifest")

    def parse(turn: int):
        return lambda files: files.select("*", N.lenient_position(N.file_name(F.col("path")))["utm_east"].alias("utm_east"), F.lit(turn).alias("parsed_in"))

    sinks.updated_manifest(before, folder, parse(1))
    again, counts = sinks.updated_manifest(before, folder, parse(9))
    if counts["parsed"] or counts["removed"] or counts["kept"] != again.count():
        raise AssertionError(f"an unchanged listing was not found again: {counts}")
    return sinks.updated_manifest(now.filter(i % 10 != 0).drop("image_id"), folder, parse(2))[0].select("path", "utm_east", "parsed_in")


@query(
    "table_fingerprint",
    W.ctes(W.SHOTS) + "SELECT count(*) AS rows, true AS same FROM shots",
)
def table_fingerprint(spark, sf):
    table = W.shots(spark, sf)
    shuffled = sinks.redealt(table, 5, "utm_east")
    return sinks.fingerprint(table).alias("a").join(
        sinks.fingerprint(shuffled).alias("b"), F.col("a.rows") == F.col("b.rows")
    ).select(F.col("a.rows").alias("rows"), (F.col("a.digest") == F.col("b.digest")).alias("same"))


# -- embedding of missing images, in batch and as a stream ---------------------


def _path_model():
    """A stand-in model: four numbers from the file name of each path."""
    import numpy as np

    def model(paths):
        numbers = np.array([int(p.rsplit("/", 1)[1].removesuffix(".jpg")) for p in paths])
        return np.stack([numbers % 7, numbers % 11, numbers % 13, numbers % 17], axis=1)

    return model


EMBEDDED_SQL = """SELECT image_path, source,
    CAST(image_id % 7 AS VARCHAR) || ',' || CAST(image_id % 11 AS VARCHAR) || ',' || CAST(image_id % 13 AS VARCHAR) || ',' || CAST(image_id % 17 AS VARCHAR) AS vector"""


def _vector_text(df):
    return df.select(
        W.cut_path("image_path").alias("image_path"), "source",
        F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"),
    )


@query("embed_missing_images", W.ctes(W.SHOTS) + EMBEDDED_SQL + " FROM shots WHERE source = 'msls'")
def embed_missing_images(spark, sf):
    store = fresh(spark, "store")
    shots = W.whole_paths(W.shots(spark, sf))
    half = shots.filter(F.col("heading") < 180)
    embed.embed_missing(half, store, "msls", _path_model)
    embed.embed_missing(shots, store, "msls", _path_model)
    return _vector_text(spark.read.parquet(store))


@query("images_to_embed", W.ctes(W.SHOTS) + "SELECT source, image_path FROM shots WHERE source = 'sf_xl' AND heading >= 90")
def images_to_embed(spark, sf):
    shots = W.whole_paths(W.shots(spark, sf))
    found = embed.missing_images(shots, shots.filter(F.col("heading") < 90), "sf_xl")
    return found.withColumn("image_path", W.cut_path("image_path"))


@query("embedding_stream", W.ctes(W.SHOTS) + EMBEDDED_SQL + " FROM shots")
def embedding_stream(spark, sf):
    """Two runs of the stream: the second one sees old and new manifest files."""
    feed, store, checkpoint = (fresh(spark, x) for x in ("feed", "store", "checkpoint"))
    shots = W.whole_paths(W.shots(spark, sf))
    for part in (shots.filter(F.col("heading") < 200), shots.filter(F.col("heading") >= 150)):
        part.write.mode("append").parquet(feed)
        stream = embed_stream.manifest_stream(spark, feed)
        embed_stream.embed_stream(stream, store, checkpoint, _path_model, 256).awaitTermination()
    return _vector_text(embed_stream.embedded(spark, store))
