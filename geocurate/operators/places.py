"""Place assignment on a grid, and filters on places."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.functions import geo
from geocurate.operators import checks
from geocurate.operators.ids import dense_ids, factorize, offset_by_existing, sampled_keys
from geocurate.runtime import dealt, stage


#: Places that are sent to every task (8 bytes each) where rows are filtered by place.
_BROADCAST_PLACES = 1_000_000
#: Bytes in memory of an image with its matches, about.
_ROW_BYTES = 256


def add_cells(df: DataFrame, cell_m: float, heading_deg: float | None = None) -> DataFrame:
    """Add the grid cell of each row; cells that are already set are kept."""

    def filled(name: str, value):
        return F.coalesce(F.col(name), value) if name in df.columns else value

    out = df.withColumn("cell_x", filled("cell_x", geo.cell(F.col("utm_east"), cell_m)))
    out = out.withColumn("cell_y", filled("cell_y", geo.cell(F.col("utm_north"), cell_m)))
    if heading_deg is not None:
        out = out.withColumn(
            "cell_h", filled("cell_h", geo.heading_bucket(F.col("heading"), heading_deg))
        )
    return out


@dataclass(frozen=True)
class GridExtent:
    """What one pass over gridded rows finds: counts of bad rows and the radices."""

    rows: int
    missing_position: int
    missing_heading: int
    negative: int
    n_y: int
    n_h: int


def grid_extent(df: DataFrame, use_heading: bool = True) -> GridExtent:
    heading = checks.is_missing("heading") if use_heading else F.lit(False)
    cell_h = F.col("cell_h") if use_heading else F.lit(0).cast("long")
    lost = F.col("_lost") if "_lost" in df.columns else F.col("cell_x").isNull() | F.col("cell_y").isNull()
    row = df.agg(
        F.count("*").alias("rows"), F.count_if(lost).alias("missing_position"), F.count_if(heading).alias("missing_heading"),
        F.count_if((F.col("cell_y") < 0) | (cell_h < 0)).alias("negative"),
        F.coalesce(F.max("cell_y") + 1, F.lit(1)).alias("n_y"), F.coalesce(F.max(cell_h) + 1, F.lit(1)).alias("n_h"),
    ).first()
    return GridExtent(**row.asDict())


def linear_place_key(df: DataFrame, use_heading: bool = True, extent: GridExtent | None = None) -> DataFrame:
    """Add ``place_id`` as the mixed-radix number of the cell.

    The radices are the largest cell indices plus one; the key is one-to-one for
    non-negative y and heading cells.
    """
    extent = extent or grid_extent(df, use_heading)
    if use_heading:
        key = (F.col("cell_x") * extent.n_y + F.col("cell_y")) * extent.n_h + F.col("cell_h")
    else:
        key = F.col("cell_x") * extent.n_y + F.col("cell_y")
    return df.withColumn("place_id", key.cast("long"))


def assign_places(
    df: DataFrame,
    cell_m: float,
    heading_deg: float | None = 30.0,
    zone_col: str | None = None,
) -> DataFrame:
    """Give every row a place.

    Rows that come with a ``place_id`` keep their grouping: (source, place_id) is
    renumbered from 0.  The other rows get the key of their grid cell, shifted past
    the existing numbers.  All rows end with cell columns.  Equal coordinates of two
    UTM zones share a cell unless *zone_col* separates them.

    One aggregate over the new rows checks positions, headings and cells and finds the
    radices; a row that can't get a place fails the call, none is lost.
    """
    use_heading = heading_deg is not None
    has_places = "place_id" in df.columns
    fresh = df.filter(F.col("place_id").isNull()).drop("place_id") if has_places else df
    # a position may be missing only where the cell is given
    lost = checks.is_missing("utm_east") | checks.is_missing("utm_north")
    for cell in ("cell_x", "cell_y"):
        if cell in fresh.columns:
            lost = lost & F.col(cell).isNull()
    gridded = add_cells(fresh.withColumn("_lost", lost), cell_m, heading_deg)
    extent = grid_extent(gridded, use_heading)
    gridded = gridded.drop("_lost")
    if extent.missing_position:
        raise checks.DataCheckError(
            f"place assignment: {extent.missing_position} of {extent.rows} images are missing a position"
        )
    if extent.missing_heading:
        raise checks.DataCheckError(
            f"place assignment: {extent.missing_heading} of {extent.rows} images are missing a heading value"
        )
    if extent.negative:
        raise checks.DataCheckError(f"place assignment: {extent.negative} rows have a negative cell index")
    keyed = linear_place_key(gridded, use_heading, extent)
    if zone_col:
        keyed = factorize(keyed, [zone_col, "place_id"], "place_id")
    if not has_places:
        return keyed
    kept = factorize_sources(add_cells(df.filter(F.col("place_id").isNotNull()), cell_m, heading_deg))
    return kept.unionByName(offset_by_existing(keyed, kept, "place_id"), allowMissingColumns=True)


def factorize_sources(df: DataFrame) -> DataFrame:
    """Renumber the places of several sources so that they cannot collide."""
    return factorize(df, ["source", "place_id"], "place_id")


def refactorize(df: DataFrame) -> DataFrame:
    """Close the gaps in ``place_id``, keeping the order."""
    return factorize(df, ["place_id"], "place_id")


def place_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("place_id").agg(F.count("*").alias("num_images"))


def min_images(df: DataFrame, threshold: int) -> DataFrame:
    """Keep the rows of places that hold at least *threshold* images.

    The places are written, so that who reads the rows several times counts them once.
    """
    return df if threshold <= 1 else _kept(df, threshold)[0]


def _kept(df: DataFrame, threshold: int) -> tuple[DataFrame, int]:
    """Rows of places that hold enough images, and how many they are."""
    sizes = stage(place_sizes(df), "place_sizes").df
    enough = F.col("num_images") >= threshold
    n = sizes.agg(
        F.coalesce(F.sum("num_images"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(enough, F.col("num_images"))), F.lit(0)).alias("kept"),
        F.count_if(enough).alias("places"),
    ).first()
    chosen = sizes.filter(enough).select("place_id")
    if n["places"] <= _BROADCAST_PLACES:
        return df.join(F.broadcast(chosen), "place_id", "left_semi"), n["kept"]
    size = n["rows"], _ROW_BYTES
    return dealt(df, *size, "place_id").join(dealt(chosen, *size, "place_id"), "place_id", "left_semi"), n["kept"]


def remove_small_places(df: DataFrame, threshold: int) -> DataFrame:
    """:func:`min_images`, and take removed images out of the ``matches`` lists.

    Only matches that are lost are sent back to their images; the order in a list is kept.
    """
    if threshold <= 1:
        return df
    kept, n = _kept(df, threshold)
    if "matches" not in df.columns:
        return kept
    size = n, _ROW_BYTES
    alive = stage(kept.select(F.col("image_id").alias("_match")), "alive").df
    links = kept.select("image_id", F.explode("matches").alias("_match"))
    gone = (
        dealt(links, *size, "_match").join(dealt(alive, *size, "_match"), "_match", "left_anti")
        .groupBy("image_id").agg(F.collect_set("_match").alias("_gone"))
    )
    lost = F.coalesce("_gone", F.slice("matches", 1, 0))
    return (
        dealt(kept, *size, "image_id").join(dealt(gone, *size, "image_id"), "image_id", "left")
        .withColumn("matches", F.filter("matches", lambda m: m.isNotNull() & ~F.array_contains(lost, m)))
        .drop("_gone")
    )


def remove_unmatched(df: DataFrame) -> DataFrame:
    return df.filter(F.size("matches") > 0)


def subsample_source_places(
    df: DataFrame, source: str, fraction: float, seed: int = 42
) -> DataFrame:
    """Keep a fraction of the places that *source* touches.

    Only rows of that source are affected.  Place and image numbers are made
    contiguous again afterwards.
    """
    checks.require_fraction(fraction)
    own = df.filter(F.col("source") == source)
    keep = sampled_keys(own, ["place_id"], fraction, seed)
    rest = df.filter(~F.col("source").eqNullSafe(F.lit(source)))
    kept = own.join(keep, "place_id", "left_semi").unionByName(rest)
    return dense_ids(refactorize(kept), ["image_id"], "image_id_new").drop("image_id").withColumnRenamed(
        "image_id_new", "image_id"
    )


def subsample_tiles(
    df: DataFrame, fraction: float = 1.0, tile_m: float = 100.0, seed: int = 42
) -> DataFrame:
    """Keep the images of a fraction of the occupied coarse tiles.  An image without a position is an error: it has no tile."""
    if fraction >= 1.0:
        return df
    checks.require_fraction(fraction)
    checks.require_position(df, "tile subsample")
    tiled = df.withColumn("_tx", geo.cell(F.col("utm_east"), tile_m)).withColumn(
        "_ty", geo.cell(F.col("utm_north"), tile_m)
    )
    keep = sampled_keys(tiled, ["_tx", "_ty"], fraction, seed)
    return tiled.join(keep, ["_tx", "_ty"], "left_semi").drop("_tx", "_ty")


def combine(frames: list[DataFrame]) -> DataFrame:
    """Append manifests in the given order and renumber the images."""
    tagged = [frame.withColumn("_part", F.lit(i)) for i, frame in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    numbered = dense_ids(union, ["_part", "image_id"], "image_id_new")
    return numbered.drop("image_id", "_part").withColumnRenamed("image_id_new", "image_id")


def uniform_supergroup(df: DataFrame) -> DataFrame:
    """Baseline without supergroups: every place is in group 0."""
    return df.withColumn("supergroup_id", F.lit(0).cast("long"))


def cells_of_places(df: DataFrame) -> DataFrame:
    """One row per place with the cell of its first image."""
    cells = [c for c in ("cell_x", "cell_y", "cell_h") if c in df.columns]
    return (
        df.groupBy("place_id")
        .agg(F.min_by(F.struct(*cells), F.col("image_id")).alias("_cell"))
        .select("place_id", *[F.col("_cell")[c].alias(c) for c in cells])
    )


