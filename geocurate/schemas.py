"""Declared schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


#: Training manifest as read: one row per image.
MANIFEST = _schema(
    ("image_id", T.LongType()),
    ("image_path", T.StringType()),
    ("utm_east", T.DoubleType()),
    ("utm_north", T.DoubleType()),
    ("heading", T.DoubleType()),
    ("source", T.StringType()),
)

#: Training manifest after places and supergroups were assigned.
TRAIN = _schema(
    *[(f.name, f.dataType) for f in MANIFEST.fields],
    ("place_id", T.LongType()),
    ("cell_x", T.LongType()),
    ("cell_y", T.LongType()),
    ("cell_h", T.LongType()),
    ("supergroup_id", T.LongType()),
)

#: Query / database manifest of a validation or test set.
EVAL = _schema(
    ("image_id", T.LongType()),
    ("image_path", T.StringType()),
    ("is_query", T.BooleanType()),
    ("utm_east", T.DoubleType()),
    ("utm_north", T.DoubleType()),
    ("matches", T.ArrayType(T.LongType())),
)

#: Image embedding store, partitioned on disk by source.
IMAGE_EMBEDDINGS = _schema(
    ("image_path", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType())),
    ("source", T.StringType()),
)

#: Place embedding store.
PLACE_EMBEDDINGS = _schema(
    ("place_id", T.LongType()),
    ("embedding", T.ArrayType(T.DoubleType())),
)

#: City CSV of street-view images.
CITY_CSV = _schema(
    ("city_id", T.StringType()),
    ("place_id", T.LongType()),
    ("year", T.IntegerType()),
    ("month", T.IntegerType()),
    ("northdeg", T.IntegerType()),
    ("lat", T.DoubleType()),
    ("lon", T.DoubleType()),
    ("panoid", T.StringType()),
)

#: Evaluation metrics, one row per (run, dataset, metric).
METRICS = _schema(
    ("run", T.StringType()),
    ("dataset", T.StringType()),
    ("metric", T.StringType()),
    ("value", T.DoubleType()),
)
