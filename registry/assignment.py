"""Identifiers, places, filters, samples and joins over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.operators import checks, embed, ids, matches, places
from geocurate.runtime import stage
from registry import query
from registry import views as W
from registry.readers import MATCHES_SQL, grouped

PLACED = W.ctes(W.SHOTS, W.placed("shots"))
GROUPED = W.ctes(W.SHOTS, W.grouped("shots"))


def placed(spark, sf):
    return places.assign_places(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)


# -- identifiers ----------------------------------------------------------------


@query(
    "dense_image_ids",
    W.ctes(W.SHOTS) + "SELECT image_path, row_number() OVER (ORDER BY image_path) - 1 AS image_id FROM shots",
)
def dense_image_ids(spark, sf):
    return ids.dense_ids(W.shots(spark, sf).select("image_path"), ["image_path"])


@query(
    "place_codes",
    PLACED + "SELECT image_id, dense_rank() OVER (ORDER BY place_id) - 1 AS place_id FROM shots_placed",
)
def place_codes(spark, sf):
    return places.refactorize(placed(spark, sf)).select("image_id", "place_id")


@query(
    "cross_source_codes",
    W.ctes(W.SHOTS)
    + "SELECT image_id, dense_rank() OVER (ORDER BY source, image_id % 500) - 1 AS place_id FROM shots",
)
def cross_source_codes(spark, sf):
    numbered = W.shots(spark, sf).withColumn("place_id", F.col("image_id") % 500)
    return places.factorize_sources(numbered).select("image_id", "place_id")


@query(
    "offset_ids",
    W.ctes(W.SHOTS)
    + """SELECT image_id + (SELECT max(image_id) + 1 FROM shots WHERE source = 'msls') AS image_id, image_path
    FROM shots WHERE source <> 'msls'""",
)
def offset_ids(spark, sf):
    shots = W.shots(spark, sf)
    moved = ids.offset_by_existing(shots.filter("source <> 'msls'"), shots.filter("source = 'msls'"), "image_id")
    return moved.select("image_id", "image_path")


MIXED_SQL = W.ctes(
    W.SHOTS,
    """own AS (SELECT *, CASE WHEN source IN ('gsvcities', 'pitts30k') THEN image_id % 700 END AS own_id FROM shots),
    kept AS (SELECT image_id, dense_rank() OVER (ORDER BY source, own_id) - 1 AS place_id,
      CAST(floor(utm_east / 50e0) AS BIGINT) AS cell_x, CAST(floor(utm_north / 50e0) AS BIGINT) AS cell_y,
      CAST(floor(heading / 60e0) AS BIGINT) AS cell_h FROM own WHERE own_id IS NOT NULL),
    cells AS (SELECT image_id, CAST(floor(utm_east / 50e0) AS BIGINT) AS cell_x, CAST(floor(utm_north / 50e0) AS BIGINT) AS cell_y,
      CAST(floor(heading / 60e0) AS BIGINT) AS cell_h FROM own WHERE own_id IS NULL),
    top AS (SELECT max(cell_y) + 1 AS ny, max(cell_h) + 1 AS nh FROM cells)""",
)


@query(
    "mixed_place_assignment",
    MIXED_SQL
    + """SELECT image_id, place_id, cell_x, cell_y, cell_h FROM kept UNION ALL
    SELECT image_id, cell_x * (ny * nh) + cell_y * nh + cell_h + (SELECT max(place_id) + 1 FROM kept), cell_x, cell_y, cell_h FROM cells, top""",
)
def mixed_place_assignment(spark, sf):
    given = F.when(F.col("source").isin("gsvcities", "pitts30k"), F.col("image_id") % 700)
    mixed = places.assign_places(W.shots(spark, sf).withColumn("place_id", given), W.CELL_M, W.HEADING_DEG)
    return mixed.select("image_id", "place_id", "cell_x", "cell_y", "cell_h")


@query(
    "zoned_place_assignment",
    PLACED
    + """SELECT image_id, dense_rank() OVER (ORDER BY image_id % 2, place_id) - 1 AS place_id FROM shots_placed""",
)
def zoned_place_assignment(spark, sf):
    shots = W.shots(spark, sf).withColumn("zone", F.col("image_id") % 2)
    return places.assign_places(shots, W.CELL_M, W.HEADING_DEG, zone_col="zone").select("image_id", "place_id")


@query(
    "city_prefixes",
    W.ctes(W.SHOTS)
    + "SELECT image_id, image_id % 5000 + (dense_rank() OVER (ORDER BY source) - 1) * 100000 AS place_id FROM shots",
)
def city_prefixes(spark, sf):
    from geocurate.sources.cities import CITY_PREFIX, city_ordinals

    shots = W.shots(spark, sf).withColumnRenamed("source", "file_city")
    prefixed = shots.join(F.broadcast(city_ordinals(shots, None)), "file_city")
    return prefixed.select("image_id", (F.col("image_id") % 5000 + F.col("ordinal") * CITY_PREFIX).alias("place_id"))


@query(
    "local_place_ids",
    GROUPED
    + """SELECT DISTINCT supergroup_id, place_id, dense_rank() OVER (PARTITION BY supergroup_id ORDER BY place_id) - 1 AS local_id FROM shots_grouped""",
)
def local_place_ids(spark, sf):
    distinct = grouped(spark, sf).select("supergroup_id", "place_id").distinct()
    return ids.rank_in_group(distinct, ["supergroup_id"], ["place_id"], "local_id")


# -- filters ----------------------------------------------------------------------


@query("one_source", W.ctes(W.SHOTS) + "SELECT image_id, image_path FROM shots WHERE source = 'pitts30k'")
def one_source(spark, sf):
    return W.shots(spark, sf).filter(F.col("source") == "pitts30k").select("image_id", "image_path")


@query(
    "min_images_filter",
    PLACED
    + "SELECT image_id, place_id FROM shots_placed WHERE place_id IN (SELECT place_id FROM shots_placed GROUP BY 1 HAVING count(*) >= 8)",
)
def min_images_filter(spark, sf):
    return places.min_images(placed(spark, sf), 8).select("image_id", "place_id")


LINKED = W.ctes(
    W.SHOTS, W.placed("shots"),
    """links AS (SELECT image_id, place_id, unnest([image_id + 10, image_id + 1, image_id + 20, image_id - 10]) AS link,
       unnest([1, 2, 3, 4]) AS pos FROM shots_placed),
    alive AS (SELECT image_id FROM shots_placed WHERE place_id IN (SELECT place_id FROM shots_placed GROUP BY 1 HAVING count(*) >= 6)),
    pruned AS (SELECT image_id, string_agg(CAST(link AS VARCHAR), ',' ORDER BY pos) AS matches FROM links
       WHERE image_id IN (SELECT image_id FROM alive) AND link IN (SELECT image_id FROM alive) GROUP BY 1)""",
)


def linked(spark, sf):
    i = F.col("image_id")
    return placed(spark, sf).withColumn("matches", F.array(i + 10, i + 1, i + 20, i - 10))


@query(
    "small_places_removed",
    LINKED + "SELECT image_id, coalesce(matches, '') AS matches FROM alive LEFT JOIN pruned USING (image_id)",
)
def small_places_removed(spark, sf):
    kept = places.remove_small_places(linked(spark, sf), 6)
    return kept.select("image_id", F.array_join("matches", ",").alias("matches"))


@query("unmatched_images_removed", LINKED + "SELECT image_id FROM pruned")
def unmatched_images_removed(spark, sf):
    return places.remove_unmatched(places.remove_small_places(linked(spark, sf), 6)).select("image_id")


@query(
    "source_subsample",
    W.ctes(
        W.SHOTS, W.placed("shots"),
        """touched AS (SELECT DISTINCT place_id FROM shots_placed WHERE source = 'sf_xl'),
        ranked AS (SELECT place_id, row_number() OVER (ORDER BY md5('42:' || CAST(place_id AS VARCHAR)), place_id) AS r FROM touched),
        kept AS (SELECT * FROM shots_placed WHERE source <> 'sf_xl'
          OR place_id IN (SELECT place_id FROM ranked WHERE r <= greatest(1, CAST(floor((SELECT count(*) FROM touched) * 0.5e0) AS BIGINT))))""",
    )
    + """SELECT row_number() OVER (ORDER BY image_id) - 1 AS image_id, image_path, dense_rank() OVER (ORDER BY place_id) - 1 AS place_id FROM kept""",
)
def source_subsample(spark, sf):
    return places.subsample_source_places(placed(spark, sf), "sf_xl", 0.5).select("image_id", "image_path", "place_id")


@query(
    "tile_subsample",
    W.ctes(
        W.SHOTS,
        """tiled AS (SELECT image_id, CAST(floor(utm_east / 100e0) AS BIGINT) AS tx, CAST(floor(utm_north / 100e0) AS BIGINT) AS ty FROM shots),
        tiles AS (SELECT DISTINCT tx, ty FROM tiled),
        ranked AS (SELECT tx, ty, row_number() OVER (ORDER BY md5('42:' || CAST(tx AS VARCHAR) || ':' || CAST(ty AS VARCHAR)), tx, ty) AS r FROM tiles)""",
    )
    + """SELECT image_id FROM tiled JOIN ranked USING (tx, ty) WHERE r <= greatest(1, CAST(floor((SELECT count(*) FROM tiles) * 0.25e0) AS BIGINT))""",
)
def tile_subsample(spark, sf):
    return places.subsample_tiles(W.shots(spark, sf), 0.25).select("image_id")


@query("city_allow_list", W.ctes(W.SHOTS) + "SELECT image_id, source FROM shots WHERE source IN ('msls', 'sf_xl')")
def city_allow_list(spark, sf):
    wanted = spark.createDataFrame([("msls",), ("sf_xl",)], "source string")
    return W.shots(spark, sf).join(F.broadcast(wanted), "source", "left_semi").select("image_id", "source")


@query(
    "combined_sources",
    W.ctes(W.SHOTS)
    + """SELECT row_number() OVER (ORDER BY CASE source WHEN 'msls' THEN 0 ELSE 1 END, image_id) - 1 AS image_id, image_path,
    CASE WHEN source <> 'msls' THEN image_id % 9 END AS place_id FROM shots""",
)
def combined_sources(spark, sf):
    shots = W.shots(spark, sf)
    first = shots.filter("source = 'msls'")
    second = shots.filter("source <> 'msls'").withColumn("place_id", F.col("image_id") % 9)
    return places.combine([first, second]).select("image_id", "image_path", "place_id")


# -- joins and sets ---------------------------------------------------------------


@query(
    "images_with_vectors",
    W.ctes(W.SHOTS_VECTORS)
    + "SELECT image_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM shots_vectors",
)
def images_with_vectors(spark, sf):
    vectors = W.table(spark, sf, "embeddings")
    n = vectors.count()
    # the store names the vectors by number
    known = W.shots(spark, sf).select("image_id", "source", (F.col("image_id") % n).alias("vec_id")).join(
        vectors.select("vec_id"), "vec_id", "left_semi"
    )
    named = W.whole_paths(stage(known, "known_images").df)
    images, store = named.select("image_id", "source", "image_path"), named.select("source", "image_path", "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return embed.attach(images, store, vectors).select("image_id", F.round(total, 4).alias("total"))


@query(
    "supergroup_of_images",
    GROUPED + "SELECT image_id, supergroup_id FROM shots_grouped",
)
def supergroup_of_images(spark, sf):
    table = grouped(spark, sf).groupBy("place_id").agg(F.min("supergroup_id").alias("supergroup_id"))
    return placed(spark, sf).join(table, "place_id").select("image_id", "supergroup_id")


@query(
    "radius_pairs",
    W.ctes(W.SHOTS_EVAL, MATCHES_SQL("shots_eval", 10)) + "SELECT query_id, database_id FROM pairs",
)
def radius_pairs(spark, sf):
    return matches.radius_pairs(W.shots_eval(spark, sf), 10)


@query(
    "query_matches",
    W.ctes(W.IMG_EVAL, MATCHES_SQL("img_eval", 10))
    + "SELECT image_id, is_query, matches FROM img_eval LEFT JOIN lists ON query_id = image_id WHERE NOT is_query OR matches IS NOT NULL",
)
def query_matches(spark, sf):
    matched = matches.add_matches(W.img_eval(spark, sf), 10)
    return matched.select("image_id", "is_query", F.array_join("matches", ",").alias("matches"))


@query(
    "place_images_of_kept_tiles",
    PLACED
    + """SELECT image_id FROM shots_placed WHERE (cell_x, cell_y) IN (SELECT (cell_x, cell_y) FROM shots_placed GROUP BY cell_x, cell_y HAVING count(*) >= 20)""",
)
def place_images_of_kept_tiles(spark, sf):
    table = placed(spark, sf)
    busy = table.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n")).filter("n >= 20")
    return table.join(busy, ["cell_x", "cell_y"], "left_semi").select("image_id")


@query(
    "appended_manifests",
    W.ctes(W.SHOTS) + "SELECT image_id, source FROM shots UNION ALL SELECT vec_id, 'img' FROM embeddings",
)
def appended_manifests(spark, sf):
    own = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit("img").alias("source"))
    return W.shots(spark, sf).select("image_id", "source").unionByName(own)


@query(
    "distinct_places",
    GROUPED + "SELECT DISTINCT supergroup_id, place_id FROM shots_grouped",
)
def distinct_places(spark, sf):
    return grouped(spark, sf).select("supergroup_id", "place_id").distinct()


@query(
    "distinct_place_cells",
    PLACED + "SELECT DISTINCT place_id, cell_x, cell_y, cell_h FROM shots_placed",
)
def distinct_place_cells(spark, sf):
    return places.cells_of_places(placed(spark, sf))


@query(
    "user_step",
    PLACED + "SELECT place_id, count(*) AS num_images FROM shots_placed GROUP BY 1 HAVING count(*) > 1",
)
def user_step(spark, sf):
    """Steps of the caller are functions from table to table."""
    return (
        W.shots(spark, sf)
        .transform(places.assign_places, W.CELL_M, W.HEADING_DEG)
        .transform(places.place_sizes)
        .transform(lambda sizes: sizes.filter("num_images > 1"))
    )


FRACTIONS = (0.0, 0.25, 1.0, 1.5)


@query(
    "fraction_check",
    W.ctes(W.SHOTS, W.placed("shots"), "own AS (SELECT count(DISTINCT place_id) AS n FROM shots_placed WHERE source = 'sf_xl')")
    + " UNION ALL ".join(
        f"SELECT {f}e0 AS fraction, " + (f"CAST(greatest(1, floor(n * {f}e0)) AS BIGINT)" if 0 < f <= 1 else "CAST(NULL AS BIGINT)") + " AS num_places FROM own"
        for f in FRACTIONS
    ),
)
def fraction_check(spark, sf):
    """Places of a source that each fraction keeps; null where the fraction is refused."""
    placed = places.assign_places(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)
    lines = []
    for fraction in FRACTIONS:
        try:
            kept = places.subsample_source_places(placed, "sf_xl", fraction).filter("source = 'sf_xl'")
            counted = kept.agg(F.count_distinct("place_id").alias("num_places"))
        except checks.DataCheckError:
            counted = placed.limit(1).select(F.lit(None).cast("long").alias("num_places"))
        lines.append(counted.select(F.lit(fraction).alias("fraction"), "num_places"))
    return reduce(DataFrame.unionByName, lines)
