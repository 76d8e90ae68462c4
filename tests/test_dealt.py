"""A task's share of a wide shuffle doesn't grow with the input."""

import pytest
from pyspark.sql import functions as F

from geocurate import runtime
from geocurate.operators import coherence, embed, places
from geocurate.sources import sinks


def images(spark, n=600):
    i = F.col("id")
    vector = F.array(*[((i * k) % 11 - 5).cast("float") for k in (1, 3, 7)])
    return spark.range(n).select(
        i.alias("image_id"), (i % 40).alias("place_id"), F.lit("s").alias("source"), F.concat(F.lit("p"), i).alias("image_path"),
        F.array(i + 1, i - 1, i + 40).alias("matches"), vector.alias("embedding"),
    )


def attached(df):
    return embed.attach(df.select("image_id", "source", "image_path"), df)


def scored(df):
    return coherence.coherence(df.select("image_id", "place_id", "embedding"))


def filtered(df):
    return coherence.coherence_filter(df.select("image_id", "place_id", "embedding"), 0.1)


def unlinked(df):
    return places.remove_small_places(df.filter("image_id < 590").select("image_id", "place_id", "matches"), 15)


@pytest.mark.parametrize("step", [attached, scored, filtered, unlinked])
def test_more_rows_are_more_tasks_with_the_same_result(spark, monkeypatch, step):
    before = sorted(map(str, step(images(spark)).collect()))
    monkeypatch.setattr(runtime, "TASK_BYTES", 1 << 12, raising=False)
    monkeypatch.setattr(places, "_BROADCAST_PLACES", 0, raising=False)
    df = step(images(spark))
    assert df.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(str, df.collect())) == before and before


def test_large_partitions_are_cut(spark):
    """A number of partitions that is given doesn't make a task's share grow with the input."""
    df = spark.range(0, 40_000, 1, 16).select(F.col("id"), (F.col("id") % 7).alias("key"), F.md5(F.col("id").cast("string")).alias("text"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64k")
        again = sinks.redealt(df, 5, "key")
        shares = again.rdd.glom().map(len).collect()
        assert len(shares) > 10 and max(shares) < 40_000 / 10 and sum(shares) == 40_000
        assert sinks.fingerprint(again).first() == sinks.fingerprint(df).first()
    finally:
        spark.conf.set(key, before)
