"""Reading of stored datasets, embedding stores and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.operators import checks
from geocurate.runtime import path_exists
from geocurate.schemas import EVAL, IMAGE_EMBEDDINGS, PLACE_EMBEDDINGS

EVAL_SPLITS = ("val", "test")


def load_train(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/train/{name}/images"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"train dataset not found: {path}")
    return spark.read.parquet(path)


def load_eval(spark: SparkSession, root: str, name: str, splits=EVAL_SPLITS) -> DataFrame:
    """The stored evaluation set of that name, looked up in the splits in order."""
    tried = [f"{root}/{split}/{name}/images" for split in splits]
    for path in tried:
        if path_exists(spark, path):
            return spark.read.schema(EVAL).parquet(path)
    raise FileNotFoundError(f"dataset {name!r} not found, searched: {', '.join(tried)}")


def load_test(spark: SparkSession, root: str, name: str) -> DataFrame:
    return load_eval(spark, root, name, splits=("test",))


def load_embeddings(
    spark: SparkSession, store: str, source: str | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Image vectors, whole, of one source (partition pruning), or of given ids.

    *ids* is a frame with ``image_path``, and ``source`` where paths repeat between sources; an image without a
    vector is an error, and so is a path without a source that several sources hold.
    """
    table = spark.read.schema(IMAGE_EMBEDDINGS).parquet(store)
    if source is not None:
        table = table.filter(F.col("source") == source)
    if ids is None:
        return table
    keys = ["source", "image_path"] if "source" in ids.columns else ["image_path"]
    checks.require_keys(ids, table, keys, "image paths")
    wanted = table.join(ids.select(*keys).distinct(), keys, "left_semi")
    if source is None and len(keys) == 1:
        several = wanted.groupBy("image_path").agg(F.count_distinct("source").alias("n")).filter("n > 1").count()
        if several:
            raise checks.DataCheckError(f"{several} image paths belong to several sources; name the source")
    return wanted


def load_place_embeddings(spark: SparkSession, store: str, ids: DataFrame | None = None) -> DataFrame:
    table = spark.read.schema(PLACE_EMBEDDINGS).parquet(store)
    if ids is None:
        return table
    checks.require_keys(ids, table, ["place_id"], "place_ids")
    return table.join(ids.select("place_id").distinct(), "place_id")


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, dataset, metric, value) of stored recall reports, averages included."""
    report = spark.read.schema(
        "checkpoint string, metrics map<string, map<string, double>>, average map<string, double>"
    ).json(path)
    per_dataset = report.select(
        F.col("checkpoint").alias("run"), F.explode("metrics").alias("dataset", "values")
    ).select("run", "dataset", F.explode("values").alias("metric", "value"))
    average = report.select(
        F.col("checkpoint").alias("run"), F.lit("average").alias("dataset"),
        F.explode("average").alias("metric", "value"),
    )
    return per_dataset.unionByName(average)
