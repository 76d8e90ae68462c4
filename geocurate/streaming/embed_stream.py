"""Incremental embedding of manifest files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from geocurate.operators.embed import Model, apply_model
from geocurate.runtime import path_exists
from geocurate.schemas import IMAGE_EMBEDDINGS, MANIFEST


def manifest_stream(
    spark: SparkSession, path: str, schema=MANIFEST, glob: str | None = None, files_per_batch: int = 64
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def embed_stream(
    images: DataFrame,
    store: str,
    checkpoint: str,
    load_model: Callable[[], Model],
    batch_size: int = 32,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Embed what is new, batch by batch, and stop when the input is used up.

    Each micro-batch appends the vectors of images that the store lacks.  After a
    crash the checkpoint repeats only the open batch, and the anti join keeps a
    half-written batch from being embedded twice.
    """
    embed = transform or (lambda todo: apply_model(todo, load_model, batch_size))

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates(["source", "image_path"])
        if path_exists(spark, store):
            have = spark.read.schema(IMAGE_EMBEDDINGS).parquet(store).select("source", "image_path")
            todo = todo.join(have, ["source", "image_path"], "left_anti")
        embed(todo).select("image_path", "embedding", "source").write.mode("append").partitionBy(
            "source"
        ).parquet(store)

    return (
        images.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def embedded(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(IMAGE_EMBEDDINGS).parquet(store)
