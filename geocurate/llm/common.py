"""Helpers the text operators share: keyed joins that survive hot keys, and components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.runtime import stage

#: A key is heavy when it holds at least one row in so many; there can be no more heavy keys than this.
HEAVY_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the other letters are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of *rows* with *lookup* (one row per *key*) that no hot key can hold up.

    ``size`` is the column of *lookup* that says how many rows the key has.  Keys that
    hold a thousandth of all rows or more are at most a thousand, so they are broadcast;
    the others are joined by a shuffle, where no task can get more than its share.
    Both inputs should be stored tables, as each is read twice.  Null keys join nothing.
    """
    total = lookup.agg(F.sum(size)).first()[0] or 0
    is_heavy = F.col(size) * HEAVY_SHARE >= F.lit(total)
    heavy = F.broadcast(lookup.filter(is_heavy))
    light = lookup.filter(~is_heavy)
    return rows.join(heavy, key).unionByName(
        rows.join(heavy.select(key), key, "left_anti").join(light.hint("merge"), key)
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected *links*: rows (node, root), root the smallest node.

    Roots are lowered by alternating two joins: every node takes the smallest root among
    its neighbours' roots, then the root of its root.  The count of rounds grows with the
    logarithm of the longest shortest path, not with its length.  Each round is a stored
    table, so a lost executor costs one round.  A group of n nodes costs n rows a round
    whatever its shape.  Links with a null end are ignored.
    """
    edges = stage(
        links.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
        .select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        .distinct(),
        "edges",
    ).df
    roots = stage(
        edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root"))
        .unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("root")))
        .groupBy("node").agg(F.min("root").alias("root")),
        "roots",
    )
    while True:
        # an edge between two roots lowers the larger one, for all nodes that hang on it
        of_x = roots.df.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        of_y = roots.df.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        between = (
            edges.join(of_x, "x").join(of_y, "y").filter("rx <> ry")
            .select(F.greatest("rx", "ry").alias("root"), F.least("rx", "ry").alias("lower"))
        )
        lowered = between.groupBy("root").agg(F.min("lower").alias("lower"))
        moved = stage(lowered, "lowered")
        hops = moved.df
        if hops.isEmpty():
            return roots.df
        # follow the chain root -> lower -> lower ... until no root is lowered any more
        while True:
            onward = hops.select(F.col("root").alias("lower"), F.col("lower").alias("lowest"))
            chained = stage(
                hops.join(onward, "lower", "left")
                .select("root", F.coalesce("lowest", "lower").alias("lower"), F.col("lowest").isNotNull().alias("went")),
                "hops",
            ).df
            hops = chained.select("root", "lower")
            if not chained.filter("went").limit(1).count():
                break
        before = roots
        roots = stage(
            before.df.join(hops, "root", "left").select("node", F.coalesce("lower", "root").alias("root")),
            "roots",
        )
        before.drop()
