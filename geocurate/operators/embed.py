"""Embedding of images that are not in the store yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.operators import checks
from geocurate.operators.blocks import vector_size
from geocurate.runtime import dealt, path_exists
from geocurate.schemas import IMAGE_EMBEDDINGS

#: Bytes of an image and its keys beside the vector, about.
_ROW_BYTES = 256

#: A model takes a list of image paths and returns an (n, d) array.
Model = Callable[[list[str]], np.ndarray]


def missing_images(images: DataFrame, stored: DataFrame | None, source: str) -> DataFrame:
    """Distinct (source, image_path) of one source that have no stored vector."""
    wanted = images.filter(F.col("source") == source).select("source", "image_path").distinct()
    if stored is None:
        return wanted
    have = stored.filter(F.col("source") == source).select("source", "image_path")
    return wanted.join(have, ["source", "image_path"], "left_anti")


def apply_model(paths: DataFrame, load_model: Callable[[], Model], batch_size: int = 32) -> DataFrame:
    """Embed each path: the model is loaded once per task and called per batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for part in parts:
            names, made = part.column(0).to_pylist(), []
            for start in range(0, len(names), batch_size):
                chunk = names[start : start + batch_size]
                made.append(np.asarray(model(chunk), dtype=np.float32))
                if len(made[-1]) != len(chunk):
                    raise ValueError(f"the model made {len(made[-1])} vectors of {len(chunk)} paths")
            if made:
                x = np.concatenate(made)
                offsets = (np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)
                vectors = pa.ListArray.from_arrays(offsets, x.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), vectors, part.column(1)], ["image_path", "embedding", "source"])

    return paths.select("image_path", "source").mapInArrow(run, IMAGE_EMBEDDINGS)


def embed_missing(
    images: DataFrame,
    store: str,
    source: str,
    load_model: Callable[[], Model],
    batch_size: int = 32,
) -> None:
    """Append the vectors of images of *source* that the store lacks."""
    spark = images.sparkSession
    stored = spark.read.schema(IMAGE_EMBEDDINGS).parquet(store) if path_exists(spark, store) else None
    todo = missing_images(images, stored, source)
    apply_model(todo, load_model, batch_size).write.mode("append").partitionBy("source").parquet(store)


def attach(images: DataFrame, store: DataFrame, vectors: DataFrame | None = None, number: str = "vec_id") -> DataFrame:
    """Images with their vector, joined on (source, image_path).

    An image without a vector, or with several, fails the call; no row is lost or doubled.
    With *vectors* the store holds no vectors but each image's *number* in that table: images meet their numbers
    first, so that a vector is moved once and not with every image that it belongs to.
    """
    keys = ["source", "image_path"]
    rows = images.count()
    checks.require_vectors(images, store, keys, "image vectors", rows)
    # both sides are dealt by their bytes, or a task would sort its share of all vectors
    if vectors is None:
        return _met(images, store.select(*keys, "embedding"), keys, rows, 8 * vector_size(store, "embedding") + _ROW_BYTES)
    numbered = _met(images, store.select(*keys, number), keys, rows, _ROW_BYTES)
    checks.require_vectors(store, vectors, [number], "numbered vectors", rows)
    return _met(numbered, vectors.select(number, "embedding"), [number], rows, _ROW_BYTES).drop(number)


def _met(images: DataFrame, held: DataFrame, keys: list[str], rows: int, row_bytes: int) -> DataFrame:
    return dealt(images, rows, row_bytes, *keys).join(dealt(held, rows, row_bytes, *keys), keys)
