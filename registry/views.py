"""Manifests derived from the given tables, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.functions import vectors as V

# Origin of the derived positions, and the grid the tilt follows.
EAST0 = 551000.0
NORTH0 = 4180000.0
CELL_M = 50.0
HEADING_DEG = 60.0
SOURCES = ("gsvcities", "sf_xl", "pitts30k", "msls")
QUERY_SOURCES = ("gsvcities", "pitts30k")  # query numbers of img are even


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _source(image_id) -> F.Column:
    names = F.array(*[F.lit(s) for s in SOURCES])
    return F.element_at(names, (image_id % 4 + 1).cast("int"))


def _offset(key, step: int, extent: int):
    return ((key * step) % extent).cast("double") / 10.0


def _path(image_id, source):
    return F.concat(
        F.lit("Images/"), source, F.lit("/"), F.lpad(image_id.cast("string"), 8, "0"), F.lit(".jpg")
    )


def whole_paths(df: DataFrame) -> DataFrame:
    """*df* with paths as keys: numbers of more than eight digits aren't cut, so that no two images share one."""
    number = F.col("image_id").cast("string")
    name = F.lpad(number, F.greatest(F.length(number), F.lit(8)), "0")
    return df.withColumn("image_path", F.concat(F.lit("Images/"), "source", F.lit("/"), name, F.lit(".jpg")))


def cut_path(path) -> F.Column:
    """A whole path as SQL writes it."""
    return F.regexp_replace(path, r"(/[0-9]{8})[0-9]*\.jpg$", "$1.jpg")


def img(spark: SparkSession, sf: str) -> DataFrame:
    """One image per embedding; vectors of a place lean towards a common axis."""
    i = F.col("vec_id")
    base = table(spark, sf, "embeddings").select(
        i.alias("image_id"), _source(i).alias("source"),
        _offset(i, 7919, 1000).alias("de"), _offset(i, 104729, 1000).alias("dn"),
        ((i * 47) % 360).cast("double").alias("heading"), "embedding",
    )
    axis = (
        6 * (2 * F.floor(F.col("de") / CELL_M) + F.floor(F.col("dn") / CELL_M))
        + F.floor(F.col("heading") / HEADING_DEG)
    ).cast("int")
    tilted = base.withColumn("axis", axis).withColumn(
        "lift", (F.col("image_id") % 5).cast("double") * 0.5
    ).withColumn(
        "embedding",
        F.transform(
            "embedding",
            lambda x, k: x.cast("double") + F.when(k == F.col("axis"), F.col("lift")).otherwise(0.0),
        ),
    )
    return tilted.select(
        "image_id", _path(F.col("image_id"), F.col("source")).alias("image_path"),
        (F.lit(EAST0) + F.col("de")).alias("utm_east"), (F.lit(NORTH0) + F.col("dn")).alias("utm_north"),
        "heading", "source", V.l2_normalize(F.col("embedding")).alias("embedding"),
    )


def img_eval(spark: SparkSession, sf: str) -> DataFrame:
    return img(spark, sf).withColumn("is_query", F.col("image_id") % 10 == 0)


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """One image per (order, line); positions from part and supplier."""
    lines = table(spark, sf, "lineitem").groupBy(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id")
    ).agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
    i = F.col("image_id")
    return lines.select(
        "image_id", _path(i, _source(i)).alias("image_path"),
        (F.lit(EAST0) + _offset(F.col("pk"), 7919, 20000)).alias("utm_east"),
        (F.lit(NORTH0) + _offset(F.col("sk"), 104729, 20000)).alias("utm_north"),
        ((i * 47) % 360).cast("double").alias("heading"), _source(i).alias("source"),
    )


def shots_eval(spark: SparkSession, sf: str) -> DataFrame:
    return shots(spark, sf).withColumn("is_query", F.col("image_id") % 7 == 0)


def shots_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``shots`` with the vector of its number among the embeddings."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    return shots(spark, sf).withColumn("vec_id", F.col("image_id") % n).join(vectors, "vec_id").drop("vec_id")


def metric_results(spark: SparkSession, sf: str) -> DataFrame:
    """(run, seq, name, value): named evaluation results; names repeat."""
    runs = F.array(*[F.lit(r) for r in RUNS])
    sets = F.array(*[F.lit(d) for d in DATASETS])
    kinds = F.array(*[F.lit(k) for k in ("R@1", "R@5", "R@10", "loss")])
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, sf, "events").select(
        F.element_at(runs, (u % 8 + 1).cast("int")).alias("run"), e.alias("seq"),
        F.concat(
            F.lit("test/"), F.element_at(sets, (u % 3 + 1).cast("int")), F.lit("/"),
            F.element_at(kinds, (e % 4 + 1).cast("int")),
        ).alias("name"),
        (F.col("value") / 1000.0).alias("value"),
    )


RUNS = ("full", "raw_gps", "filter_only", "sg_only", "tau02", "tau04", "sg512", "sg2048")
DATASETS = ("pitts30k_test", "nordland_test", "msls_val")


# -- the same views as SQL ----------------------------------------------------


def _sql_source(i: str) -> str:
    return f"CASE {i} % 4 WHEN 0 THEN 'gsvcities' WHEN 1 THEN 'sf_xl' WHEN 2 THEN 'pitts30k' ELSE 'msls' END"


def _sql_path(i: str, source: str) -> str:
    return f"'Images/' || {source} || '/' || lpad(CAST({i} AS VARCHAR), 8, '0') || '.jpg'"


IMG = f"""
img0 AS (
  SELECT vec_id AS image_id, {_sql_source('vec_id')} AS source,
         CAST((vec_id * 7919) % 1000 AS DOUBLE) / 10e0 AS de,
         CAST((vec_id * 104729) % 1000 AS DOUBLE) / 10e0 AS dn,
         CAST((vec_id * 47) % 360 AS DOUBLE) AS heading, embedding
  FROM embeddings),
img1 AS (
  SELECT *, CAST(6 * (2 * floor(de / 50e0) + floor(dn / 50e0)) + floor(heading / 60e0) AS INTEGER) AS axis,
         CAST(image_id % 5 AS DOUBLE) * 0.5e0 AS lift
  FROM img0),
img2 AS (
  SELECT *, list_transform(embedding, lambda x, k: CAST(x AS DOUBLE)
                           + CASE WHEN k - 1 = axis THEN lift ELSE 0e0 END) AS raw
  FROM img1),
img AS (
  SELECT image_id, {_sql_path('image_id', 'source')} AS image_path, 551000e0 + de AS utm_east,
         4180000e0 + dn AS utm_north, heading, source,
         list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS embedding
  FROM img2)"""

IMG_EVAL = IMG + """,
img_eval AS (SELECT *, image_id % 10 = 0 AS is_query FROM img)"""

SHOTS = f"""
shots0 AS (
  SELECT l_orderkey * 10 + l_linenumber AS image_id, min(l_partkey) AS pk, min(l_suppkey) AS sk
  FROM lineitem GROUP BY 1),
shots AS (
  SELECT image_id, {_sql_path('image_id', '(' + _sql_source('image_id') + ')')} AS image_path,
         551000e0 + CAST((pk * 7919) % 20000 AS DOUBLE) / 10e0 AS utm_east,
         4180000e0 + CAST((sk * 104729) % 20000 AS DOUBLE) / 10e0 AS utm_north,
         CAST((image_id * 47) % 360 AS DOUBLE) AS heading, {_sql_source('image_id')} AS source
  FROM shots0)"""

SHOTS_EVAL = SHOTS + """,
shots_eval AS (SELECT *, image_id % 7 = 0 AS is_query FROM shots)"""

SHOTS_VECTORS = SHOTS + """,
shots_vectors AS (
  SELECT shots.*, e.embedding FROM shots
  JOIN embeddings e ON e.vec_id = shots.image_id % (SELECT count(*) FROM embeddings))"""

METRIC = """
metric AS (
  SELECT ['full','raw_gps','filter_only','sg_only','tau02','tau04','sg512','sg2048'][user_id % 8 + 1] AS run,
         event_id AS seq,
         'test/' || ['pitts30k_test','nordland_test','msls_val'][user_id % 3 + 1] || '/'
           || ['R@1','R@5','R@10','loss'][event_id % 4 + 1] AS name,
         value / 1000e0 AS value
  FROM events)"""

#: Places of shots / img on the 50 m, 60 degree grid, as dense numbers.
def placed(view: str) -> str:
    return f"""
{view}_cells AS (
  SELECT *, CAST(floor(utm_east / 50e0) AS BIGINT) AS cell_x, CAST(floor(utm_north / 50e0) AS BIGINT) AS cell_y,
         CAST(floor(heading / 60e0) AS BIGINT) AS cell_h FROM {view}),
{view}_placed AS (
  SELECT *, cell_x * ((SELECT max(cell_y) + 1 FROM {view}_cells) * (SELECT max(cell_h) + 1 FROM {view}_cells))
            + cell_y * (SELECT max(cell_h) + 1 FROM {view}_cells) + cell_h AS place_id
  FROM {view}_cells)"""


#: Supergroups for the profiling queries: the outer group of the place (N=2, L=2).
def grouped(view: str) -> str:
    return placed(view) + f""",
{view}_grouped AS (
  SELECT *, ((cell_x % 2) * 2 + cell_y % 2) * 2 + cell_h % 2 AS supergroup_id FROM {view}_placed)"""


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"
