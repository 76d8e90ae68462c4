"""Profiles of training and evaluation sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geocurate.functions import vectors as V
from geocurate.operators import pairs as P
from geocurate.operators.ids import rank_in_group, sample_hash
from geocurate.runtime import stage


def distribution(counts: DataFrame, column: str, group: list[str] | None = None, population: bool = False) -> DataFrame:
    """mean, median, min, max and standard deviation of a count column."""
    deviation = F.stddev_pop(column) if population else F.stddev_samp(column)
    return counts.groupBy(*(group or [])).agg(
        F.avg(column).alias("mean"), F.median(column).alias("median"),
        F.min(column).alias("min"), F.max(column).alias("max"), deviation.alias("std"),
    )


def images_per_place(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or ["place_id"])).agg(F.count("*").alias("num_images"))


def images_per_place_stats(df: DataFrame) -> DataFrame:
    return distribution(images_per_place(df), "num_images")


def supergroup_sizes(df: DataFrame) -> DataFrame:
    """Places and images per supergroup, from one aggregation by (supergroup, place)."""
    return images_per_place(df, ["supergroup_id", "place_id"]).groupBy("supergroup_id").agg(
        F.count("*").alias("num_places"), F.sum("num_images").alias("num_images")
    )


def places_per_supergroup_stats(df: DataFrame) -> DataFrame:
    return distribution(supergroup_sizes(df), "num_places")


def images_per_supergroup_stats(df: DataFrame) -> DataFrame:
    return distribution(supergroup_sizes(df), "num_images")


def analysis(df: DataFrame) -> DataFrame:
    """Spread of images per place, places and images per supergroup: a row per measure, with the standard deviation."""
    parts = {"images_per_place": images_per_place_stats(df)}
    if "supergroup_id" in df.columns:
        sizes = stage(supergroup_sizes(df), "supergroup_sizes").df
        parts["places_per_supergroup"] = distribution(sizes, "num_places")
        parts["images_per_supergroup"] = distribution(sizes, "num_images")
    lines = [table.select(F.lit(name).alias("measure"), "*") for name, table in parts.items()]
    return reduce(DataFrame.unionByName, lines)


def source_stats(df: DataFrame) -> DataFrame:
    """Per source: images, places, shares in percent and images-per-place spread."""
    per_place = images_per_place(df, ["source", "place_id"])
    total_images = df.agg(F.count("*")).scalar()
    total_places = df.agg(F.count_distinct("place_id")).scalar()
    out = per_place.groupBy("source").agg(
        F.sum("num_images").alias("num_images"),
        F.count("*").alias("num_places"),
        F.avg("num_images").alias("mean"), F.median("num_images").alias("median"),
        F.min("num_images").alias("min"), F.max("num_images").alias("max"),
        F.coalesce(F.stddev_samp("num_images"), F.lit(0.0)).alias("std"),
    ).withColumn("pct_images", F.col("num_images") / total_images * 100).withColumn(
        "pct_places", F.col("num_places") / total_places * 100
    )
    if "supergroup_id" in df.columns:
        groups = df.select("source", "supergroup_id").distinct().groupBy("source").agg(
            F.count("*").alias("num_supergroups")
        )
        out = out.join(groups, "source")
    return out


def supergroup_stats(df: DataFrame) -> DataFrame:
    """Per supergroup: images, places and images per place."""
    per_place = images_per_place(df, ["supergroup_id", "place_id"])
    return per_place.groupBy("supergroup_id").agg(
        F.sum("num_images").alias("num_images"), F.count("*").alias("num_places"),
        F.avg("num_images").alias("mean"), F.min("num_images").alias("min"),
        F.max("num_images").alias("max"), F.median("num_images").alias("median"),
    )


def schema_table(df: DataFrame) -> DataFrame:
    """Columns and types of a table, with its number of rows and of nulls in each column."""
    fields = list(enumerate(df.schema.fields))
    line = lambda i, f: F.struct(
        F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
        F.count(F.lit(1)).alias("num_rows"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("num_nulls"),
    )
    return df.agg(F.array(*[line(i, f) for i, f in fields]).alias("lines")).select(F.inline("lines"))


def _stats(prefix: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in prefix])


def _as_map(df: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    entries = F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v")))
    return df.agg(F.map_from_entries(F.array_sort(entries, _by_key)).alias(name))


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def _schema_struct(df: DataFrame, num_rows: Column) -> Column:
    return F.struct(
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields]).alias("types"),
        num_rows.alias("num_rows"),
    )


def train_totals(df: DataFrame) -> DataFrame:
    """Images, places, supergroups and the images-per-place spread in one row."""
    per_place = images_per_place(df)
    spread = per_place.agg(
        F.sum("num_images").alias("num_images"), F.count("*").alias("num_places"),
        F.avg("num_images").alias("mean"), F.min("num_images").alias("min"),
        F.max("num_images").alias("max"), F.median("num_images").alias("median"),
    )
    groups = (
        df.agg(F.count_distinct("supergroup_id")).scalar()
        if "supergroup_id" in df.columns else F.lit(0)
    )
    return spread.withColumn("num_supergroups", groups.cast("long"))


def train_summary(df: DataFrame) -> DataFrame:
    """One nested row: totals, schema and a block per source.

    The blocks per supergroup are the rows of :func:`supergroup_stats`: their number
    grows with the data, so they are a table and not part of this row.
    """
    stats = ["mean", "min", "max", "median"]
    out = train_totals(df).select(
        _schema_struct(df, F.col("num_images")).alias("schema"), "num_images", "num_places", "num_supergroups",
        _stats(stats).alias("images_per_place"),
    )
    if "source" in df.columns:
        block = F.struct(
            "num_images", "num_places", _stats(stats).alias("images_per_place"),
            "pct_images", "pct_places",
        )
        out = out.withColumn("sources", _as_map(source_stats(df), F.col("source"), block, "s").scalar())
    return out


def eval_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if("is_query").alias("num_queries"),
        F.count_if(~F.col("is_query")).alias("num_database"),
    )


def eval_summary(df: DataFrame) -> DataFrame:
    """Images, queries, database, matches per query, and queries without a match."""
    n = F.when(F.col("is_query"), F.greatest(F.coalesce(F.size("matches"), F.lit(0)), F.lit(0)))
    counted = df.select("is_query", n.alias("n"))
    without = F.count_if(F.col("is_query") & (F.col("n") == 0))
    queries = F.count_if("is_query")
    return counted.agg(
        F.count("*").alias("num_images"), queries.alias("num_query_images"),
        F.count_if(~F.col("is_query")).alias("num_database_images"),
        F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.median("n").alias("median"), without.alias("queries_with_no_matches"),
        F.coalesce(F.try_divide(without, queries) * 100, F.lit(0.0)).alias("queries_with_no_matches_pct"),
    )


def loader_summary(df: DataFrame) -> DataFrame:
    """(measure, mean, min, max, std): spreads of a stored training set.

    Stored place numbers are local to a supergroup, so places are counted by
    (supergroup, place).  Images per place have the sample deviation, the
    per-supergroup spreads the population deviation.
    """
    per_place = images_per_place(df, ["supergroup_id", "place_id"])
    per_group = supergroup_sizes(df)

    def line(table: DataFrame, column: str, name: str, population: bool) -> DataFrame:
        return distribution(table, column, population=population).select(
            F.lit(name).alias("measure"), "mean", "min", "max", "std"
        )

    return reduce(
        DataFrame.unionByName,
        [
            line(per_place, "num_images", "images_per_place", False),
            line(per_group, "num_places", "places_per_supergroup", True),
            line(per_group, "num_images", "images_per_supergroup", True),
        ],
    )


def train_counts(df: DataFrame) -> DataFrame:
    return images_per_place(df, ["supergroup_id", "place_id"]).agg(
        F.count_distinct("supergroup_id").alias("num_supergroups"),
        F.count("*").alias("num_places"), F.sum("num_images").alias("num_images"),
    )


def places_per_supergroup(df: DataFrame) -> DataFrame:
    return supergroup_sizes(df).select("supergroup_id", "num_places")


def place_members(df: DataFrame, chunk: int = 4096) -> DataFrame:
    """Per (supergroup, place): image paths, headings and positions in image order.

    Lists hold at most *chunk* images; a larger place continues in the next ``part``.
    """
    columns = ["image_path", "heading", "utm_east", "utm_north"]
    ranked = rank_in_group(
        df.select("supergroup_id", "place_id", "image_id", *columns),
        ["supergroup_id", "place_id"], ["image_id"], "_rank",
    )
    packed = F.array_sort(F.collect_list(F.struct("_rank", *columns)))
    return (
        ranked.withColumn("part", F.floor(F.col("_rank") / chunk).cast("int"))
        .groupBy("supergroup_id", "place_id", "part").agg(packed.alias("_m"))
        .select(
            "supergroup_id", "place_id", "part",
            F.col("_m.image_path").alias("image_paths"), F.col("_m.heading").alias("headings"),
            F.col("_m.utm_east").alias("utm_east"), F.col("_m.utm_north").alias("utm_north"),
        )
    )


def place_centroids(df: DataFrame) -> DataFrame:
    """Per place: mean position, image count and the source of the first image."""
    return df.groupBy("supergroup_id", "place_id").agg(
        F.count("*").alias("num_images"),
        F.avg("utm_east").alias("utm_east"), F.avg("utm_north").alias("utm_north"),
        F.min_by("source", "image_id").alias("source"),
    )


def supergroup_geo_stats(centroids: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Pairs, min, median, mean, max and population deviation of place distances."""
    blocks = P.place_blocks(centroids)
    moments = P.pair_moments(blocks, threshold=threshold)
    out = moments.join(P.pair_median(blocks, moments), "supergroup_id").select(
        "supergroup_id", "pairs", F.col("low").alias("min"), "median", "mean",
        F.col("high").alias("max"), "std", "under_threshold",
    )
    out = stage(out, "geo_stats").df
    blocks.drop()
    return out


def supergroup_quality(centroids: DataFrame, place_vectors: DataFrame) -> DataFrame:
    """Per supergroup: spread, mean pair cosine, and closest pair of places.

    The mean cosine of all pairs follows from the sum of the unit vectors.
    """
    blocks = P.place_blocks(centroids)
    closest = P.pair_moments(blocks).select("supergroup_id", F.col("low").alias("closest_pair"))
    spread = centroids.groupBy("supergroup_id").agg(
        F.count("*").alias("num_places"),
        (F.stddev_pop("utm_east") + F.stddev_pop("utm_north")).alias("spread"),
    )
    unit = centroids.select("supergroup_id", "place_id").join(
        place_vectors.select("place_id", V.l2_normalize(F.col("embedding"), 1e-8).alias("_u")), "place_id"
    )
    sums = unit.groupBy("supergroup_id").agg(
        F.count("*").alias("_n"), V.sum_vector(F.col("_u")).alias("_s"),
        F.sum(V.dot(F.col("_u"), F.col("_u"))).alias("_own"),
    )
    cosine = (V.dot(F.col("_s"), F.col("_s")) - F.col("_own")) / (F.col("_n") * (F.col("_n") - 1))
    out = (
        spread.join(sums, "supergroup_id").join(closest, "supergroup_id")
        .filter(F.col("num_places") > 1)
        .select("supergroup_id", "num_places", "spread", cosine.alias("mean_cosine"), "closest_pair")
    )
    out = stage(out, "supergroup_quality").df
    blocks.drop()
    return out


def supergroup_histograms(
    centroids: DataFrame, place_vectors: DataFrame, quality: DataFrame, bins: int = 60, group_bins: int = 20
) -> DataFrame:
    """(kind, supergroup_id, bin, count): distances and cosines of the places of each supergroup, and over all
    supergroups (null id) their spread, mean cosine and closest pair, from *quality*."""
    blocks = P.place_blocks(centroids.join(place_vectors.select("place_id", "embedding"), "place_id"), vectors=True)
    parts = []
    for kind in ("distance", "cosine"):
        found = P.pair_histogram(blocks, P.pair_moments(blocks, kind=kind), kind=kind, bins=bins)
        parts.append(found.select(F.lit(kind).alias("kind"), "supergroup_id", "bin", "count"))
    for kind in ("spread", "mean_cosine", "closest_pair"):
        found = P.value_histogram(quality, kind, group_bins)
        parts.append(found.select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("supergroup_id"), "bin", "count"))
    out = stage(reduce(DataFrame.unionByName, parts), "supergroup_histograms").df
    blocks.drop()
    return out


def supergroup_sources(centroids: DataFrame) -> DataFrame:
    """Places per source inside each supergroup."""
    return centroids.groupBy("supergroup_id", "source").agg(F.count("*").alias("num_places"))


def sample_places(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n places per source, chosen by hash order (one source ``all`` if there is none)."""
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit("all"))
    order = Window.partitionBy("source").orderBy("_h", "place_id")
    return (
        df.select("source", "place_id").distinct()
        .withColumn("_h", sample_hash(seed, "source", "place_id"))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= n)
        .select("source", "place_id")
    )


def sample_gallery(
    df: DataFrame, supergroups: int = 8, places: int = 20, images: int = 4, seed: int = 42
) -> DataFrame:
    """Images to look at: some supergroups, some of their places, some of their images."""
    groups = (
        df.select("supergroup_id").distinct()
        .withColumn("_h", sample_hash(seed, "supergroup_id"))
        .orderBy("_h", "supergroup_id").limit(supergroups).select("supergroup_id")
    )
    chosen = df.join(F.broadcast(groups), "supergroup_id", "left_semi")
    by_group = Window.partitionBy("supergroup_id").orderBy("_h", "place_id")
    picked = (
        chosen.select("supergroup_id", "place_id").distinct()
        .withColumn("_h", sample_hash(seed, "supergroup_id", "place_id"))
        .withColumn("_r", F.row_number().over(by_group)).filter(F.col("_r") <= places)
        .select("supergroup_id", "place_id")
    )
    by_place = Window.partitionBy("supergroup_id", "place_id").orderBy("_h", "image_id")
    return (
        chosen.select("supergroup_id", "place_id", "image_id")
        .join(F.broadcast(picked), ["supergroup_id", "place_id"], "left_semi")
        .withColumn("_h", sample_hash(seed, "image_id"))
        .withColumn("_r", F.row_number().over(by_place)).filter(F.col("_r") <= images)
        .select("supergroup_id", "place_id", "image_id")
    )
