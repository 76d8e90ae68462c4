"""Epoch plans: supergroup-pure batches of places and the images drawn for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geocurate.operators import checks
from geocurate.operators.ids import dense_ids, rank_in_group, sample_hash

PLACE = ("supergroup_id", "place_id")


def epoch_plan(
    places: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, drop_last: bool = False
) -> DataFrame:
    """(batch_id, supergroup_id, place_id) of one epoch.

    Places are shuffled inside their supergroup by a hash of (seed, epoch, place),
    cut into batches, and the batches of all supergroups are shuffled together.  A
    supergroup of any size is spread over the cluster while it is ranked.
    """
    tag = f"{seed}:{epoch}"
    shuffled = places.select(*PLACE).distinct().withColumn("_h", _tagged_hash(tag, *PLACE))
    ranked = rank_in_group(shuffled, ["supergroup_id"], ["_h", "place_id"], "_rank")
    cut = ranked.withColumn("_cut", F.floor(F.col("_rank") / batch_size).cast("long"))
    table = cut.groupBy("supergroup_id", "_cut").agg(F.count("*").alias("_n"))
    if drop_last:
        table = table.filter(F.col("_n") == batch_size)
    order = table.withColumn("_h", _tagged_hash(tag, "supergroup_id", "_cut"))
    numbered = dense_ids(order, ["_h", "supergroup_id", "_cut"], "batch_id")
    return cut.join(
        numbered.select("supergroup_id", "_cut", "batch_id"), ["supergroup_id", "_cut"]
    ).select("batch_id", *PLACE)


def _tagged_hash(tag: str, *keys: str):
    return F.md5(F.concat_ws(":", F.lit(tag), *[F.col(k).cast("string") for k in keys]))


def epoch_length(places: DataFrame, batch_size: int, drop_last: bool = False) -> DataFrame:
    """Number of batches per epoch over all supergroups."""
    share = F.col("n") / F.lit(batch_size)
    return (
        places.select(*PLACE).distinct().groupBy("supergroup_id").agg(F.count("*").alias("n"))
        .agg(F.sum(F.floor(share) if drop_last else F.ceil(share)).alias("batches"))
    )


def draw_images(
    images: DataFrame,
    per_place: int,
    seed: int = 42,
    keys: Sequence[str] = PLACE,
    strict: bool = False,
) -> DataFrame:
    """Draw *per_place* images of each place: (keys..., slot, image_id).

    Without replacement where the place has enough images, otherwise with.  In
    strict mode a place with too few images is an error.
    """
    if strict:
        checks.require_images_per_place(images, per_place, keys)
    order = Window.partitionBy(*keys).orderBy("_h", "image_id")
    first = (
        images.select(*keys, "image_id")
        .withColumn("_h", sample_hash(seed, "image_id"))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= per_place)
        .drop("_h")
    )
    # at most per_place images reach this aggregate, on the window's own partitioning
    picked = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_r", "image_id")))["image_id"].alias("_images")
    )
    n = F.size("_images")
    slots = picked.select(
        *keys, "_images", F.explode(F.sequence(F.lit(0), F.lit(per_place - 1))).alias("slot")
    )
    place = F.when(n == per_place, F.col("slot")).otherwise(_pick(seed, [*keys, "slot"], n))
    return slots.select(*keys, "slot", F.element_at("_images", place + 1).alias("image_id"))


def _pick(seed: int, keys: Sequence[str], n):
    """Hash of the keys as a number below n."""
    return F.pmod(F.conv(F.substring(sample_hash(seed, *keys), 1, 8), 16, 10).cast("long"), n).cast("int")


def collate(
    plan: DataFrame, images: DataFrame, per_place: int, seed: int = 42, strict: bool = False
) -> DataFrame:
    """Flat sample rows of an epoch: (batch_id, supergroup_id, label, slot, image_id).

    ``place_id`` is the local place number of the stored training set, so it is the
    label as it stands.
    """
    return plan.join(draw_images(images, per_place, seed, strict=strict), list(PLACE)).select(
        "batch_id", "supergroup_id", F.col("place_id").alias("label"), "slot", "image_id"
    )
