"""Neighbour search and recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.operators import matches, pivots, retrieval, substrings
from geocurate.plans import curation
from geocurate.runtime import stage
from geocurate.sources import sinks, tables
from registry import query
from registry import views as W
from registry.readers import MATCHES_SQL, fresh

KNN_SQL = """
neighbours AS (SELECT query_id, database_id, score, rank FROM (
  SELECT q.image_id AS query_id, d.image_id AS database_id, list_dot_product(q.embedding, d.embedding) AS score,
    row_number() OVER (PARTITION BY q.image_id ORDER BY list_dot_product(q.embedding, d.embedding) DESC, d.image_id) AS rank
  FROM img_eval q, img_eval d WHERE q.is_query AND NOT d.is_query) WHERE rank <= 10)"""

FIRST_SQL = """
first_hits AS (SELECT q.image_id AS query_id, min(n.rank) AS first FROM img_eval q
  LEFT JOIN (SELECT * FROM neighbours JOIN pairs USING (query_id, database_id)) n ON n.query_id = q.image_id
  WHERE q.is_query GROUP BY 1)"""


def sides(spark, sf):
    images = W.img_eval(spark, sf)
    return (
        images.filter("is_query").select("image_id", "embedding"),
        images.filter("not is_query").select("image_id", "embedding"),
    )


@query(
    "nearest_neighbours",
    W.ctes(W.IMG_EVAL, KNN_SQL) + "SELECT query_id, database_id, rank, round(score, 6) AS score FROM neighbours",
)
def nearest_neighbours(spark, sf):
    return _shown(retrieval.knn(*sides(spark, sf), 10))


@query(
    "nearest_neighbours_by_shuffle",
    W.ctes(W.IMG_EVAL, KNN_SQL) + "SELECT query_id, database_id, rank, round(score, 6) AS score FROM neighbours",
)
def nearest_neighbours_by_shuffle(spark, sf):
    """Query sets that are too large for one broadcast: several passes over the database."""
    return _shown(retrieval.knn(*sides(spark, sf), 10, max_broadcast_bytes=0, rows=16))


@query(
    "pruned_neighbours",
    W.ctes(W.IMG_EVAL, KNN_SQL) + "SELECT query_id, database_id, rank, round(score, 6) AS score FROM neighbours",
)
def pruned_neighbours(spark, sf):
    """The same from an index of blocks around pivots."""
    queries, database = sides(spark, sf)
    found, _ = pivots.search(pivots.build(stage(database, "database").df, rows=64), queries, 10)
    return _shown(found)


def _shown(found):
    return found.select("query_id", "database_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "ground_truth",
    W.ctes(
        W.IMG_EVAL, MATCHES_SQL("img_eval", 10),
        "gold AS (SELECT query_id, string_agg(CAST(database_id AS VARCHAR), ',' ORDER BY database_id) AS gold FROM pairs GROUP BY 1)",
    )
    + "SELECT image_id, coalesce(gold, '') AS gold FROM img_eval LEFT JOIN gold ON query_id = image_id WHERE is_query",
)
def ground_truth(spark, sf):
    images = W.img_eval(spark, sf)
    lists = matches.radius_pairs(images, 10).groupBy(F.col("query_id").alias("image_id")).agg(
        F.concat(F.sort_array(F.collect_list("database_id")), F.array(F.lit(-1).cast("long"))).alias("matches")
    )
    stored = images.select("image_id", "is_query").join(lists, "image_id", "left")
    return matches.ground_truth(stored).select("image_id", F.array_join("gold", ",").alias("gold"))


RECALL_SQL = W.ctes(W.IMG_EVAL, MATCHES_SQL("img_eval", 10), KNN_SQL, FIRST_SQL)


@query(
    "recall_at_k",
    RECALL_SQL
    + """SELECT CAST(k AS INTEGER) AS k, round(CAST(count(*) FILTER (first <= k) AS DOUBLE) / count(*), 9) AS recall FROM first_hits, (VALUES (1), (5), (10)) AS ks(k) GROUP BY 1""",
)
def recall_at_k(spark, sf):
    queries, database = sides(spark, sf)
    gold = matches.radius_pairs(W.img_eval(spark, sf), 10)
    found = retrieval.knn(queries, database, 10)
    recalls = retrieval.recall_at(found, gold, queries, database, [1, 5, 10])
    return recalls.select("k", F.round("recall", 9).alias("recall"))


@query(
    "mean_first_recall",
    RECALL_SQL
    + """SELECT round(avg(r), 9) AS mean_r1 FROM (SELECT CAST(count(*) FILTER (first <= 1) AS DOUBLE) / count(*) AS r FROM first_hits
    JOIN img_eval ON image_id = query_id GROUP BY source)""",
)
def mean_first_recall(spark, sf):
    """R@1 per query set (the sources of the queries), averaged."""
    queries, database = sides(spark, sf)
    origin = W.img_eval(spark, sf).select("image_id", "source")
    gold = matches.radius_pairs(W.img_eval(spark, sf), 10)
    found = stage(retrieval.knn(queries, database, 10), "found").df
    parts = [
        retrieval.recall_at(found, gold, queries.join(origin.filter(F.col("source") == s), "image_id"), database, [1])
        for s in W.QUERY_SOURCES
    ]
    return retrieval.mean_r1(reduce(DataFrame.unionByName, parts)).select(F.round("mean_r1", 9).alias("mean_r1"))


SHORTLIST_SQL = (
    W.ctes(
        W.IMG_EVAL,
        """coded AS (SELECT *, list_transform(embedding, lambda x: x >= 0) AS code FROM img_eval),
        far AS (SELECT q.image_id AS query_id, d.image_id AS database_id,
          CAST(list_sum(list_transform(range(1, 65), lambda k: CASE WHEN q.code[k] <> d.code[k] THEN 1 ELSE 0 END)) AS BIGINT) AS differing
          FROM coded q, coded d WHERE q.is_query AND NOT d.is_query)""",
    )
    + """SELECT query_id, database_id, differing FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY differing, database_id) AS r FROM far) WHERE r <= 30"""
)


@query("sign_code_shortlist", SHORTLIST_SQL)
def sign_code_shortlist(spark, sf):
    from geocurate.functions import vectors as V

    queries, database = (s.select("image_id", V.sign_code(F.col("embedding"), 64).alias("code")) for s in sides(spark, sf))
    near = retrieval.hamming_shortlist(queries, database, 30)
    return near.select("query_id", "database_id", (-F.col("score")).cast("long").alias("differing"))


@query("sign_code_shortlist_by_parts", SHORTLIST_SQL)
def sign_code_shortlist_by_parts(spark, sf):
    """The same from tables of 8-bit parts, looked up with ever more bits turned."""
    from geocurate.functions import vectors as V

    queries, database = (stage(s.select("image_id", V.sign_code(F.col("embedding"), 64).alias("code")), "codes").df for s in sides(spark, sf))
    near, _ = substrings.shortlist(substrings.build(database, 64, bits=8), queries, 30)
    return near.select("query_id", "database_id", F.col("differing").cast("long").alias("differing"))


@query(
    "two_stage_retrieval",
    W.ctes(
        W.IMG_EVAL,
        """coded AS (SELECT *, list_transform(embedding, lambda x: x >= 0) AS code FROM img_eval),
        far AS (SELECT q.image_id AS query_id, d.image_id AS database_id, list_dot_product(q.embedding, d.embedding) AS score,
          list_sum(list_transform(range(1, 65), lambda k: CASE WHEN q.code[k] <> d.code[k] THEN 1 ELSE 0 END)) AS differing
          FROM coded q, coded d WHERE q.is_query AND NOT d.is_query),
        short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY differing, database_id) AS r FROM far) WHERE r <= 30)""",
    )
    + """SELECT query_id, database_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, database_id) AS rank FROM short) WHERE rank <= 5""",
)
def two_stage_retrieval(spark, sf):
    queries, database = sides(spark, sf)
    best = retrieval.two_stage(queries, database, shortlist=30, k=5, width=64)
    return best.select("query_id", "database_id", F.col("rank").cast("long").alias("rank"))


STORED_RECALL = W.ctes(
    W.IMG_EVAL, MATCHES_SQL("img_eval", 10), KNN_SQL, FIRST_SQL,
    "judged AS (SELECT first FROM first_hits WHERE query_id IN (SELECT query_id FROM pairs))",
)


@query(
    "evaluation_run",
    STORED_RECALL
    + """SELECT CAST(k AS INTEGER) AS k, round(CAST(count(*) FILTER (first <= k) AS DOUBLE) / count(*), 9) AS recall FROM judged, (VALUES (1), (5), (10)) AS ks(k) GROUP BY 1""",
)
def evaluation_run(spark, sf):
    """An evaluation set is built and saved, read back and scored."""
    root = fresh(spark, "processed")
    images = W.img_eval(spark, sf)
    manifest = images.select("image_id", "image_path", "is_query", "utm_east", "utm_north")
    curation.build_eval_set(manifest, root, "val", "near", 10)
    recalls = curation.evaluate(tables.load_eval(spark, root, "near"), images)
    return recalls.select("k", F.round("recall", 9).alias("recall"))


@query(
    "evaluation_report",
    STORED_RECALL
    + """SELECT 'run' AS run, dataset, 'R@' || k AS metric, round(CAST(count(*) FILTER (first <= k) AS DOUBLE) / count(*), 9) AS value
    FROM judged, (VALUES (1), (5), (10)) AS ks(k), (VALUES ('near'), ('average')) AS ds(dataset) GROUP BY k, dataset""",
)
def evaluation_report(spark, sf):
    """Evaluation followed by the recall report and its reader."""
    root = fresh(spark, "processed")
    images = W.img_eval(spark, sf)
    manifest = images.select("image_id", "image_path", "is_query", "utm_east", "utm_north")
    curation.build_eval_set(manifest, root, "test", "near", 10)
    recalls = curation.evaluate(tables.load_test(spark, root, "near"), images)
    results = recalls.select(
        F.lit("run").alias("run"), F.col("k").alias("seq"),
        F.concat(F.lit("test/near/R@"), F.col("k").cast("string")).alias("name"), F.col("recall").alias("value"),
    )
    path = sinks.save_recall_report(results, fresh(spark, "report"))
    return tables.load_metrics(spark, path).withColumn("value", F.round("value", 9))


def _eval_set_sql(split: str) -> str:
    return f"""SELECT '{split}' AS split, count(*) AS num_images, count(*) FILTER (is_query) AS num_query_images,
    (SELECT count(*) FROM pairs) AS num_matches FROM img_eval WHERE NOT is_query OR image_id IN (SELECT query_id FROM pairs)"""


def _eval_set(split: str):
    def run(spark, sf):
        root = fresh(spark, "processed")
        manifest = W.img_eval(spark, sf).select("image_id", "image_path", "is_query", "utm_east", "utm_north")
        curation.build_eval_set(manifest, root, split, "near", 10)
        load = tables.load_eval if split == "val" else tables.load_test
        return load(spark, root, "near").agg(
            F.lit(split).alias("split"), F.count("*").alias("num_images"),
            F.count_if("is_query").alias("num_query_images"), F.sum(F.size("matches")).alias("num_matches"),
        )

    return run


for _split in ("val", "test"):
    query(f"{_split}_set", W.ctes(W.IMG_EVAL, MATCHES_SQL("img_eval", 10)) + _eval_set_sql(_split))(_eval_set(_split))


@query(
    "retrieved_overlaps_gold",
    W.ctes(W.IMG_EVAL, MATCHES_SQL("img_eval", 10), KNN_SQL)
    + """SELECT i.image_id, EXISTS (SELECT 1 FROM neighbours n JOIN pairs p USING (query_id, database_id)
    WHERE n.query_id = i.image_id AND n.rank <= 5) AS hit FROM img_eval i WHERE is_query""",
)
def retrieved_overlaps_gold(spark, sf):
    """Whether the first five of a query share an id with its gold set."""
    queries, database = sides(spark, sf)
    found = retrieval.knn(queries, database, 5).groupBy(F.col("query_id").alias("image_id")).agg(
        F.collect_list("database_id").alias("found")
    )
    gold = matches.radius_pairs(W.img_eval(spark, sf), 10).groupBy(F.col("query_id").alias("image_id")).agg(
        F.collect_list("database_id").alias("gold")
    )
    judged = queries.select("image_id").join(found, "image_id", "left").join(gold, "image_id", "left")
    return judged.select("image_id", F.coalesce(F.arrays_overlap("found", "gold"), F.lit(False)).alias("hit"))
