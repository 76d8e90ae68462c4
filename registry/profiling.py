"""Profiles of training and evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocurate.operators import aggregate, matches, pairs, places, profile
from geocurate.runtime import stage
from registry import query
from registry import views as W
from registry.curating import PLACE_MEANS, placed_img
from registry.readers import MATCHES_SQL, grouped

GROUPED = W.ctes(W.SHOTS, W.grouped("shots"))
SPREAD = "round(avg({c}), 6) AS mean, median({c}) AS median, min({c}) AS min, max({c}) AS max, round(stddev_samp({c}), 6) AS std"


def rounded(df, *columns, digits: int = 6):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("images_per_place", GROUPED + "SELECT place_id, count(*) AS num_images FROM shots_grouped GROUP BY 1")
def images_per_place(spark, sf):
    return profile.images_per_place(grouped(spark, sf))


@query(
    "images_per_place_stats",
    GROUPED + f"SELECT {SPREAD.format(c='n')} FROM (SELECT count(*) AS n FROM shots_grouped GROUP BY place_id)",
)
def images_per_place_stats(spark, sf):
    return rounded(profile.images_per_place_stats(grouped(spark, sf)), "mean", "std")


@query(
    "places_per_supergroup_stats",
    GROUPED + f"SELECT {SPREAD.format(c='n')} FROM (SELECT count(DISTINCT place_id) AS n FROM shots_grouped GROUP BY supergroup_id)",
)
def places_per_supergroup_stats(spark, sf):
    return rounded(profile.places_per_supergroup_stats(grouped(spark, sf)), "mean", "std")


@query(
    "images_per_supergroup_stats",
    GROUPED + f"SELECT {SPREAD.format(c='n')} FROM (SELECT count(*) AS n FROM shots_grouped GROUP BY supergroup_id)",
)
def images_per_supergroup_stats(spark, sf):
    return rounded(profile.images_per_supergroup_stats(grouped(spark, sf)), "mean", "std")


@query(
    "source_stats",
    GROUPED
    + f"""SELECT source, CAST(sum(n) AS BIGINT) AS num_images, count(*) AS num_places, {SPREAD.format(c='n')},
    round(sum(n) * 100e0 / (SELECT count(*) FROM shots_grouped), 6) AS pct_images,
    round(count(*) * 100e0 / (SELECT count(DISTINCT place_id) FROM shots_grouped), 6) AS pct_places, any_value(g) AS num_supergroups
    FROM (SELECT source, place_id, count(*) AS n FROM shots_grouped GROUP BY 1, 2)
    JOIN (SELECT source, count(DISTINCT supergroup_id) AS g FROM shots_grouped GROUP BY 1) USING (source) GROUP BY source""",
)
def source_stats(spark, sf):
    return rounded(profile.source_stats(grouped(spark, sf)), "mean", "std", "pct_images", "pct_places")


@query(
    "supergroup_stats",
    GROUPED
    + """SELECT supergroup_id, CAST(sum(n) AS BIGINT) AS num_images, count(*) AS num_places, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median
    FROM (SELECT supergroup_id, place_id, count(*) AS n FROM shots_grouped GROUP BY 1, 2) GROUP BY 1""",
)
def supergroup_stats(spark, sf):
    return rounded(profile.supergroup_stats(grouped(spark, sf)), "mean")


@query(
    "train_summary",
    GROUPED
    + """SELECT count(*) AS num_images, count(DISTINCT place_id) AS num_places, count(DISTINCT supergroup_id) AS num_supergroups,
    11 AS num_columns, count(DISTINCT source) AS source_blocks,
    (SELECT median(n) FROM (SELECT count(*) AS n FROM shots_grouped GROUP BY place_id)) AS median FROM shots_grouped""",
)
def train_summary(spark, sf):
    summary = profile.train_summary(grouped(spark, sf))
    return summary.select(
        "num_images", "num_places", "num_supergroups", F.size("schema.columns").alias("num_columns"),
        F.size("sources").cast("long").alias("source_blocks"), F.col("images_per_place.median").alias("median"),
    )


SHOT_COLUMNS = {
    "image_id": "bigint", "image_path": "string", "utm_east": "double", "utm_north": "double", "heading": "double", "source": "string",
}


@query(
    "table_schema",
    W.ctes(W.SHOTS)
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count(*) AS num_rows, count(*) FILTER ({c} IS NULL) AS num_nulls FROM shots"""
        for i, (c, t) in enumerate(SHOT_COLUMNS.items())
    ),
)
def table_schema(spark, sf):
    return profile.schema_table(W.shots(spark, sf))


@query(
    "eval_summary",
    W.ctes(W.IMG_EVAL, MATCHES_SQL("img_eval", 10),
           "per AS (SELECT i.image_id, i.is_query, CASE WHEN i.is_query THEN count(p.database_id) END AS n FROM img_eval i LEFT JOIN pairs p ON p.query_id = i.image_id GROUP BY 1, 2)")
    + """SELECT count(*) AS num_images, count(*) FILTER (is_query) AS num_query_images, count(*) FILTER (NOT is_query) AS num_database_images,
    round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, median(n) AS median, count(*) FILTER (n = 0) AS queries_with_no_matches,
    round(count(*) FILTER (n = 0) * 100e0 / count(*) FILTER (is_query), 6) AS queries_with_no_matches_pct FROM per""",
)
def eval_summary(spark, sf):
    """Of the set before queries without a match are dropped."""
    images = W.img_eval(spark, sf)
    lists = matches.add_matches(images, 10).select("image_id", "matches")
    out = profile.eval_summary(images.join(lists, "image_id", "left"))
    return rounded(out, "mean", "queries_with_no_matches_pct").select(
        *[F.col(c).cast("long").alias(c) if c in ("min", "max") else c for c in out.columns]
    )


@query(
    "eval_counts",
    W.ctes(W.SHOTS_EVAL) + "SELECT count(*) FILTER (is_query) AS num_queries, count(*) FILTER (NOT is_query) AS num_database FROM shots_eval",
)
def eval_counts(spark, sf):
    return profile.eval_counts(W.shots_eval(spark, sf))


@query(
    "train_counts",
    GROUPED
    + "SELECT count(DISTINCT supergroup_id) AS num_supergroups, count(DISTINCT place_id) AS num_places, count(*) AS num_images FROM shots_grouped",
)
def train_counts(spark, sf):
    return profile.train_counts(grouped(spark, sf))


@query("places_per_supergroup", GROUPED + "SELECT supergroup_id, count(DISTINCT place_id) AS num_places FROM shots_grouped GROUP BY 1")
def places_per_supergroup(spark, sf):
    return profile.places_per_supergroup(grouped(spark, sf))


@query(
    "loader_summary",
    GROUPED
    + """SELECT 'images_per_place' AS measure, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, round(stddev_samp(n), 6) AS std FROM (SELECT count(*) AS n FROM shots_grouped GROUP BY place_id)
    UNION ALL SELECT 'places_per_supergroup', round(avg(n), 6), min(n), max(n), round(stddev_pop(n), 6) FROM (SELECT count(DISTINCT place_id) AS n FROM shots_grouped GROUP BY supergroup_id)
    UNION ALL SELECT 'images_per_supergroup', round(avg(n), 6), min(n), max(n), round(stddev_pop(n), 6) FROM (SELECT count(*) AS n FROM shots_grouped GROUP BY supergroup_id)""",
)
def loader_summary(spark, sf):
    return rounded(profile.loader_summary(grouped(spark, sf)), "mean", "std")


@query(
    "place_members",
    GROUPED
    + """SELECT supergroup_id, place_id, (r // 16) AS part, string_agg(image_path, ',' ORDER BY r) AS paths, round(sum(heading), 3) AS headings,
    count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY supergroup_id, place_id ORDER BY image_id) - 1 AS r FROM shots_grouped) GROUP BY 1, 2, 3""",
)
def place_members(spark, sf):
    members = profile.place_members(grouped(spark, sf), chunk=16)
    return members.select(
        "supergroup_id", "place_id", F.col("part").cast("long").alias("part"),
        F.array_join("image_paths", ",").alias("paths"),
        F.round(F.aggregate("headings", F.lit(0.0), lambda a, x: a + x), 3).alias("headings"),
        F.size("utm_east").cast("long").alias("n"),
    )


CENTROIDS = "centroids AS (SELECT supergroup_id, place_id, count(*) AS num_images, avg(utm_east) AS utm_east, avg(utm_north) AS utm_north, arg_min(source, image_id) AS source FROM {view} GROUP BY 1, 2)"
PAIRS = """
geo AS (SELECT a.supergroup_id, sqrt((a.utm_east - b.utm_east) * (a.utm_east - b.utm_east) + (a.utm_north - b.utm_north) * (a.utm_north - b.utm_north)) AS d
  FROM centroids a JOIN centroids b ON a.supergroup_id = b.supergroup_id AND a.place_id < b.place_id)"""
SHOT_PAIRS = W.ctes(W.SHOTS, W.grouped("shots"), CENTROIDS.format(view="shots_grouped"), PAIRS)


def centroids(spark, sf):
    return stage(profile.place_centroids(grouped(spark, sf)), "centroids").df


@query(
    "place_centroids",
    W.ctes(W.SHOTS, W.grouped("shots"), CENTROIDS.format(view="shots_grouped"))
    + "SELECT supergroup_id, place_id, num_images, round(utm_east, 6) AS utm_east, round(utm_north, 6) AS utm_north, source FROM centroids",
)
def place_centroids(spark, sf):
    return rounded(profile.place_centroids(grouped(spark, sf)), "utm_east", "utm_north")


@query(
    "supergroup_geo_stats",
    SHOT_PAIRS
    + """SELECT supergroup_id, count(*) AS pairs, round(min(d), 3) AS min, round(median(d), 3) AS median, round(avg(d), 3) AS mean,
    round(max(d), 3) AS max, round(stddev_pop(d), 3) AS std, count(*) FILTER (d < 25) AS under_threshold FROM geo GROUP BY 1""",
)
def supergroup_geo_stats(spark, sf):
    stats = profile.supergroup_geo_stats(centroids(spark, sf))
    return rounded(stats, "min", "median", "mean", "max", "std", digits=3)


@query(
    "distance_histogram",
    SHOT_PAIRS
    + """SELECT supergroup_id, CAST(least(floor((d - lo) / (hi - lo) * 60), 59) AS INTEGER) AS bin, count(*) AS count
    FROM geo JOIN (SELECT supergroup_id, min(d) AS lo, max(d) AS hi FROM geo GROUP BY 1) USING (supergroup_id) GROUP BY 1, 2""",
)
def distance_histogram(spark, sf):
    blocks = pairs.place_blocks(centroids(spark, sf))
    return pairs.pair_histogram(blocks, pairs.pair_moments(blocks))


VECTOR_PAIRS = W.ctes(
    W.IMG, W.grouped("img"), CENTROIDS.format(view="img_grouped"), PAIRS,
    PLACE_MEANS,
    """cos AS (SELECT a.supergroup_id, list_dot_product(v.embedding, w.embedding) AS s FROM centroids a JOIN centroids b
      ON a.supergroup_id = b.supergroup_id AND a.place_id < b.place_id JOIN place_vec v ON v.place_id = a.place_id JOIN place_vec w ON w.place_id = b.place_id)""",
)


def img_groups(spark, sf):
    x, y, h = (F.col(c) for c in ("cell_x", "cell_y", "cell_h"))
    placed = placed_img(spark, sf).withColumn("supergroup_id", ((x % 2) * 2 + y % 2) * 2 + h % 2)
    vectors = stage(aggregate.place_embeddings(placed), "vectors").df
    return stage(profile.place_centroids(placed), "centroids").df, vectors


@query(
    "supergroup_quality",
    VECTOR_PAIRS
    + """SELECT supergroup_id, num_places, round(spread, 3) AS spread, round(mean_cosine, 6) AS mean_cosine, round(closest_pair, 3) AS closest_pair FROM
    (SELECT supergroup_id, count(*) AS num_places, stddev_pop(utm_east) + stddev_pop(utm_north) AS spread FROM centroids GROUP BY 1)
    JOIN (SELECT supergroup_id, avg(s) AS mean_cosine FROM cos GROUP BY 1) USING (supergroup_id)
    JOIN (SELECT supergroup_id, min(d) AS closest_pair FROM geo GROUP BY 1) USING (supergroup_id)""",
)
def supergroup_quality(spark, sf):
    quality = profile.supergroup_quality(*img_groups(spark, sf))
    return rounded(rounded(quality, "spread", "closest_pair", digits=3), "mean_cosine")


@query(
    "similarity_histogram",
    VECTOR_PAIRS
    + """SELECT supergroup_id, CAST(CASE WHEN hi > lo THEN least(floor((s - lo) / (hi - lo) * 60), 59) ELSE 0 END AS INTEGER) AS bin, count(*) AS count
    FROM cos JOIN (SELECT supergroup_id, min(s) AS lo, max(s) AS hi FROM cos GROUP BY 1) USING (supergroup_id) GROUP BY 1, 2""",
)
def similarity_histogram(spark, sf):
    table, vectors = img_groups(spark, sf)
    blocks = pairs.place_blocks(table.join(vectors, "place_id"), vectors=True)
    return pairs.pair_histogram(blocks, pairs.pair_moments(blocks, kind="cosine"), kind="cosine")


@query(
    "spread_histogram",
    W.ctes(W.SHOTS, W.grouped("shots"), CENTROIDS.format(view="shots_grouped"),
           "spreads AS (SELECT supergroup_id, stddev_pop(utm_east) + stddev_pop(utm_north) AS s FROM centroids GROUP BY 1)")
    + """SELECT CAST(least(floor((s - (SELECT min(s) FROM spreads)) / ((SELECT max(s) FROM spreads) - (SELECT min(s) FROM spreads)) * 20), 19) AS INTEGER) AS bin,
    count(*) AS count FROM spreads GROUP BY 1""",
)
def spread_histogram(spark, sf):
    spreads = centroids(spark, sf).groupBy("supergroup_id").agg(
        (F.stddev_pop("utm_east") + F.stddev_pop("utm_north")).alias("spread")
    )
    return pairs.value_histogram(spreads, "spread", 20)


@query(
    "supergroup_sources",
    W.ctes(W.SHOTS, W.grouped("shots"), CENTROIDS.format(view="shots_grouped"))
    + "SELECT supergroup_id, source, count(*) AS num_places FROM centroids GROUP BY 1, 2",
)
def supergroup_sources(spark, sf):
    return profile.supergroup_sources(profile.place_centroids(grouped(spark, sf)))


SIMILARITY = W.ctes(
    W.IMG, W.placed("img"),
    """sims AS (SELECT a.place_id, a.image_id, list_dot_product(a.embedding, b.embedding) AS s FROM img_placed a
      JOIN img_placed b ON a.place_id = b.place_id AND a.image_id <> b.image_id)""",
)


@query(
    "place_similarity",
    SIMILARITY
    + "SELECT place_id, image_id, round(min(s), 6) AS low, round(avg(s), 6) AS mean, round(max(s), 6) AS high FROM sims GROUP BY 1, 2",
)
def place_similarity(spark, sf):
    return rounded(pairs.row_profile(placed_img(spark, sf)), "low", "mean", "high")


@query(
    "sampled_places",
    W.ctes(W.SHOTS, W.placed("shots"))
    + """SELECT source, place_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || source || ':' || CAST(place_id AS VARCHAR)), place_id) AS r
    FROM (SELECT DISTINCT source, place_id FROM shots_placed)) WHERE r <= 16""",
)
def sampled_places(spark, sf):
    placed = places.assign_places(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)
    return profile.sample_places(placed, 16)


@query(
    "sampled_gallery",
    GROUPED.rstrip()
    + """,
g AS (SELECT supergroup_id FROM (SELECT DISTINCT supergroup_id FROM shots_grouped) ORDER BY md5('42:' || CAST(supergroup_id AS VARCHAR)), supergroup_id LIMIT 3),
p AS (SELECT supergroup_id, place_id FROM (SELECT *, row_number() OVER (PARTITION BY supergroup_id ORDER BY md5('42:' || CAST(supergroup_id AS VARCHAR) || ':' || CAST(place_id AS VARCHAR)), place_id) AS r
  FROM (SELECT DISTINCT supergroup_id, place_id FROM shots_grouped WHERE supergroup_id IN (SELECT supergroup_id FROM g))) WHERE r <= 20)
SELECT supergroup_id, place_id, image_id FROM (SELECT s.supergroup_id, s.place_id, image_id, row_number() OVER (PARTITION BY s.supergroup_id, s.place_id ORDER BY md5('42:' || CAST(image_id AS VARCHAR)), image_id) AS r
  FROM shots_grouped s JOIN p ON p.place_id = s.place_id) WHERE r <= 4""",
)
def sampled_gallery(spark, sf):
    return profile.sample_gallery(grouped(spark, sf), supergroups=3)
