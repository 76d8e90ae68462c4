"""Coherence, place vectors, clustering and whole curation plans."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.functions import vectors as V
from geocurate.operators import aggregate, coherence, elimination, places, supergroups
from geocurate.plans import curation
from geocurate.runtime import stage
from registry import query
from registry import views as W
from registry.readers import fresh


def placed_img(spark, sf):
    return places.assign_places(W.img(spark, sf), W.CELL_M, W.HEADING_DEG)


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


#: Element-wise sum of a list column per group as SQL.
def list_sums(source: str, out: str, group: str, column: str = "embedding", agg: str = "sum") -> str:
    return f"""
{out} AS (SELECT {group}, list(s ORDER BY k) AS vec, any_value(n) AS n FROM (
  SELECT {group}, k, {agg}(x) AS s, count(*) AS n FROM (
    SELECT {group}, unnest({column}) AS x, unnest(range(64)) AS k FROM {source}) GROUP BY {group}, k) GROUP BY {group})"""


@query(
    "image_coherence",
    W.ctes(W.IMG, W.placed("img"), list_sums("img_placed", "sums", "place_id"))
    + f"""SELECT image_id, CASE WHEN n > 1 THEN round(({_dot('embedding', 'vec')} - {_dot('embedding', 'embedding')}) / (n - 1), 6) END AS coherence
    FROM img_placed JOIN sums USING (place_id)""",
)
def image_coherence(spark, sf):
    return coherence.coherence(placed_img(spark, sf)).select("image_id", F.round("coherence", 6).alias("coherence"))


@query(
    "image_coherence_large",
    W.ctes(
        W.SHOTS_VECTORS, W.placed("shots_vectors"),
        "units AS (SELECT * REPLACE (list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS embedding) FROM shots_vectors_placed)",
        list_sums("units", "sums", "place_id"),
    )
    + f"""SELECT image_id, CASE WHEN n > 1 THEN round(({_dot('embedding', 'vec')} - {_dot('embedding', 'embedding')}) / (n - 1), 5) + 0e0 END AS coherence
    FROM units JOIN sums USING (place_id)""",
)
def image_coherence_large(spark, sf):
    placed = places.assign_places(W.shots_vectors(spark, sf), W.CELL_M, W.HEADING_DEG)
    narrow = placed.select("image_id", "place_id", "embedding")  # a Python step gets every column it is given
    return coherence.coherence(narrow).select("image_id", (F.round("coherence", 5) + 0.0).alias("coherence"))


def drops(start: str, up_to: float, out: str) -> str:
    """Who falls when, by "score all that are left, drop the worst below *up_to*" until none falls."""
    return f"""
{out}_sims AS (SELECT a.place_id, a.image_id AS a, b.image_id AS b, {_dot('a.embedding', 'b.embedding')} AS s
  FROM {start} a JOIN {start} b ON a.place_id = b.place_id AND a.image_id <> b.image_id),
{out}_steps AS (
  SELECT 0 AS step, place_id, image_id, false AS fell, CAST(NULL AS DOUBLE) AS score FROM {start}
  UNION ALL
  SELECT r.step + 1, r.place_id, r.image_id, r.image_id = w.fallen, w.score FROM {out}_steps r JOIN (
    SELECT place_id, arg_min(a, (round(score, 12), a)) AS fallen, min(score) AS score FROM (
      SELECT s.place_id, s.a, avg(s.s) AS score FROM {out}_sims s
      JOIN {out}_steps x ON x.image_id = s.a JOIN {out}_steps y ON y.image_id = s.b WHERE NOT x.fell AND NOT y.fell GROUP BY s.place_id, s.a)
    GROUP BY place_id HAVING min(score) < {up_to}e0) w USING (place_id)
  WHERE NOT r.fell),
{out} AS (SELECT place_id, image_id, CAST(step AS BIGINT) AS step, score FROM {out}_steps WHERE fell)"""


def filtered(start: str, tau: float, least: int, out: str) -> str:
    """What the threshold leaves in places with at least *least* images left."""
    return drops(start, tau, f"{out}_drops") + f""",
{out}_alive AS (SELECT * FROM {start} WHERE image_id NOT IN (SELECT image_id FROM {out}_drops)),
{out} AS (SELECT * FROM {out}_alive WHERE place_id IN (SELECT place_id FROM {out}_alive GROUP BY 1 HAVING count(*) >= {least}))"""


KEPT = filtered("img_placed", 0.3, 15, "kept")


@query(
    "elimination_order",
    W.ctes(W.IMG, W.placed("img"), drops("img_placed", 0.4, "fallen"))
    + """SELECT image_id, place_id, step, round(max(score) OVER (PARTITION BY place_id ORDER BY step), 9) + 0e0 AS reach FROM fallen""",
)
def elimination_order(spark, sf):
    """Step and reach of every image that a threshold up to 0.4 drops."""
    order = elimination.elimination(placed_img(spark, sf), [0.4]).filter("step IS NOT NULL")
    return order.select("image_id", "place_id", "step", (F.round("reach", 9) + 0.0).alias("reach"))


TAUS = (0.2, 0.3, 0.4)


@query(
    "threshold_survivors",
    W.ctes(W.IMG, W.placed("img"), *[drops("img_placed", t, f"fallen{i}") for i, t in enumerate(TAUS)])
    + " UNION ALL ".join(
        f"SELECT {t}e0 AS tau, image_id FROM img_placed WHERE image_id NOT IN (SELECT image_id FROM fallen{i})" for i, t in enumerate(TAUS)
    ),
)
def threshold_survivors(spark, sf):
    """Three thresholds from one stored order; the SQL filters for each of them anew."""
    order = stage(elimination.elimination(placed_img(spark, sf), TAUS), "elimination").df
    each = [elimination.survivors(order, t).select(F.lit(t).alias("tau"), "image_id") for t in TAUS]
    return reduce(DataFrame.unionByName, each)


@query(
    "threshold_place_means",
    W.ctes(
        W.IMG, W.placed("img"), *[drops("img_placed", t, f"fallen{i}") for i, t in enumerate(TAUS)],
        *[f"alive{i} AS (SELECT * FROM img_placed WHERE image_id NOT IN (SELECT image_id FROM fallen{i}))" for i in range(3)],
        *[list_sums(f"alive{i}", f"means{i}", "place_id", agg="avg").strip() for i in range(3)],
    )
    + " UNION ALL ".join(f"SELECT {t}e0 AS tau, place_id, unnest(range(64)) AS dim, round(unnest(vec), 6) + 0e0 AS x FROM means{i}" for i, t in enumerate(TAUS)),
)
def threshold_place_means(spark, sf):
    """Mean vectors of the survivors at three thresholds, from places in rounds over blocks and from one pass over the rest."""
    order = elimination.elimination(placed_img(spark, sf), TAUS, place_means=True, max_task_values=64 * 21, round_candidates=8)
    means = order.select("place_id", F.posexplode("place_means").alias("at", "mean")).filter("mean IS NOT NULL")
    tau = F.element_at(F.array(*[F.lit(t) for t in TAUS]), F.col("at") + 1).alias("tau")
    each = means.select(tau, "place_id", F.posexplode("mean").alias("dim", "x"))
    return each.select("tau", "place_id", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query(
    "coherence_filter",
    W.ctes(W.IMG, W.placed("img"), KEPT) + "SELECT image_id, place_id FROM kept",
)
def coherence_filter(spark, sf):
    kept = coherence.coherence_filter(placed_img(spark, sf), tau=0.3, min_images=15)
    return kept.select("image_id", "place_id")


@query(
    "coherence_filter_in_rounds",
    W.ctes(W.IMG, W.placed("img"), KEPT) + "SELECT image_id, place_id FROM kept",
)
def coherence_filter_in_rounds(spark, sf):
    """The same filter with a task limit so low that the places take the rounds."""
    kept = coherence.coherence_filter(
        placed_img(spark, sf), tau=0.3, min_images=15, max_task_values=64 * 19, round_candidates=6
    )
    return kept.select("image_id", "place_id")


@query(
    "coherence_filter_off",
    W.ctes(W.IMG, W.placed("img")) + "SELECT image_id, place_id FROM img_placed",
)
def coherence_filter_off(spark, sf):
    return coherence.coherence_filter(placed_img(spark, sf), tau=-1.0, min_images=1).select("image_id", "place_id")


@query(
    "coherent_place_codes",
    W.ctes(W.IMG, W.placed("img"), KEPT)
    + "SELECT image_id, dense_rank() OVER (ORDER BY place_id) - 1 AS place_id FROM kept",
)
def coherent_place_codes(spark, sf):
    kept = coherence.staged_filter(placed_img(spark, sf), tau=0.3, min_images=15)
    return places.refactorize(kept).select("image_id", "place_id")


PLACE_MEANS = list_sums("img_placed", "means", "place_id", agg="avg").strip() + """,
place_vec AS (SELECT place_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS embedding FROM means)"""


@query(
    "place_embeddings",
    W.ctes(W.IMG, W.placed("img"), PLACE_MEANS)
    + "SELECT place_id, unnest(range(64)) AS dim, round(unnest(embedding), 6) + 0e0 AS x FROM place_vec",
)
def place_embeddings(spark, sf):
    return _elements(aggregate.place_embeddings(placed_img(spark, sf)))


@query(
    "place_means",
    W.ctes(W.IMG, W.placed("img"), PLACE_MEANS)
    + "SELECT place_id, unnest(range(64)) AS dim, round(unnest(vec), 6) + 0e0 AS x FROM means",
)
def place_means(spark, sf):
    """Without scaling, and with the reduction given as a function of the caller."""
    return _elements(aggregate.place_embeddings(placed_img(spark, sf), V.mean_vector, normalize=False))


def _elements(df):
    return df.select("place_id", F.posexplode("embedding").alias("dim", "x")).select(
        "place_id", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x")
    )


SHARE = """
place_groups AS (SELECT place_id, ((cell_x % 2) * 2 + cell_y % 2) * 2 + cell_h % 2 AS outer_group
  FROM (SELECT DISTINCT place_id, cell_x, cell_y, cell_h FROM {view})),
share0 AS (SELECT outer_group, count(*) AS n FROM place_groups GROUP BY 1),
share1 AS (SELECT outer_group, n, CAST(least(n, greatest(1, round_even(CAST(n AS DOUBLE) / (SELECT sum(n) FROM share0)
  * greatest(1, (SELECT sum(n) FROM share0) // {size}), 0))) AS BIGINT) AS k FROM share0),
share AS (SELECT *, CAST(coalesce(sum(k) OVER (ORDER BY outer_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM share1)"""


@query(
    "cluster_allocation",
    W.ctes(W.SHOTS, W.placed("shots"), SHARE.format(view="shots_placed", size=300)) + "SELECT outer_group, n, k, first FROM share",
)
def cluster_allocation(spark, sf):
    placed = places.assign_places(W.shots(spark, sf), W.CELL_M, W.HEADING_DEG)
    return supergroups.allocate_k(supergroups.outer_groups(places.cells_of_places(placed), 2, 2), 300)


def _unrolled_kmeans(steps: int) -> str:
    """Seeds by hash, then *steps* rounds of assignment and renormalised means."""
    parts = [
        """pts AS (SELECT place_id, outer_group, list_transform(embedding, lambda x: x / greatest(sqrt(list_dot_product(embedding, embedding)), 1e-8)) AS v
        FROM place_vec JOIN place_groups USING (place_id))""",
        """c0 AS (SELECT outer_group, cluster, v FROM (SELECT *, row_number() OVER (PARTITION BY outer_group ORDER BY md5('42:' || CAST(place_id AS VARCHAR)), place_id) - 1 AS cluster
        FROM pts) JOIN share USING (outer_group) WHERE cluster < k)""",
    ]

    def assign(i: int, out: str) -> str:
        return f"""{out} AS (SELECT place_id, outer_group, cluster, v FROM (SELECT p.place_id, p.outer_group, c.cluster, p.v,
        row_number() OVER (PARTITION BY p.place_id ORDER BY list_dot_product(p.v, c.v) DESC, c.cluster) AS r
        FROM pts p JOIN c{i} c ON c.outer_group = p.outer_group) WHERE r = 1)"""

    for i in range(steps):
        parts.append(assign(i, f"a{i}"))
        parts.append(list_sums(f"a{i}", f"s{i}", "outer_group, cluster", "v").strip())
        parts.append(
            f"""c{i + 1} AS (SELECT c.outer_group, c.cluster, CASE WHEN s.vec IS NULL THEN c.v
            ELSE list_transform(s.vec, lambda x: x / sqrt(list_dot_product(s.vec, s.vec))) END AS v
            FROM c{i} c LEFT JOIN s{i} s ON s.outer_group = c.outer_group AND s.cluster = c.cluster)"""
        )
    parts.append(assign(steps, "labels"))
    return ",\n".join(parts)


def _recursive_kmeans(steps: int) -> str:
    """:func:`_unrolled_kmeans` until no centroid moves, in at most *steps* rounds."""
    points, seeds = _unrolled_kmeans(0).split(",\nc0 AS")[0], "c0 AS" + _unrolled_kmeans(0).split(",\nc0 AS")[1].split(",\nlabels AS")[0]
    nearest = """SELECT p.place_id, p.outer_group, c.cluster, p.v, row_number() OVER (PARTITION BY p.place_id
      ORDER BY list_dot_product(p.v, c.v) DESC, c.cluster) AS r FROM pts p JOIN {centroids} c ON c.outer_group = p.outer_group"""
    return f"""{points},
{seeds},
rounds AS (
  SELECT 0 AS step, outer_group, cluster, v, true AS moved FROM c0
  UNION ALL
  SELECT step + 1, outer_group, cluster, w, list_distance(v, w) > 1e-9 FROM (
    SELECT c.step, c.outer_group, c.cluster, c.v, CASE WHEN s.vec IS NULL THEN c.v
      ELSE list_transform(s.vec, lambda x: x / sqrt(list_dot_product(s.vec, s.vec))) END AS w
    FROM rounds c LEFT JOIN (
      SELECT outer_group, cluster, list(t ORDER BY i) AS vec FROM (
        SELECT outer_group, cluster, i, sum(x) AS t FROM (
          SELECT outer_group, cluster, unnest(v) AS x, unnest(range(64)) AS i FROM ({nearest.format(centroids='rounds')}) WHERE r = 1)
        GROUP BY 1, 2, 3) GROUP BY 1, 2) s ON s.outer_group = c.outer_group AND s.cluster = c.cluster
    WHERE c.step < {steps} AND (SELECT bool_or(moved) FROM rounds))),
final AS (SELECT * FROM rounds WHERE step = (SELECT max(step) FROM rounds)),
labels AS (SELECT place_id, outer_group, cluster, v FROM ({nearest.format(centroids='final')}) WHERE r = 1)"""


KMEANS = W.ctes(
    W.IMG, W.placed("img"), PLACE_MEANS, SHARE.format(view="img_placed", size=2), _unrolled_kmeans(3)
)


def _clustering_input(spark, sf):
    placed = stage(placed_img(spark, sf), "placed").df
    table = supergroups.outer_groups(places.cells_of_places(placed), 2, 2)
    points = table.select("place_id", "outer_group").join(aggregate.place_embeddings(placed), "place_id")
    return points, supergroups.allocate_k(table, 2)


@query("spherical_kmeans", KMEANS + "SELECT place_id, outer_group, cluster FROM labels")
def spherical_kmeans(spark, sf):
    points, share = _clustering_input(spark, sf)
    return supergroups.spherical_kmeans(points, share, max_iter=3).select("place_id", "outer_group", "cluster")


@query("spherical_kmeans_by_shuffle", KMEANS + "SELECT place_id, outer_group, cluster FROM labels")
def spherical_kmeans_by_shuffle(spark, sf):
    """The path for centroids that are too many to broadcast or to fit one block."""
    points, share = _clustering_input(spark, sf)
    labels = supergroups.spherical_kmeans(points, share, max_iter=3, rows=2, max_broadcast_bytes=0)
    return labels.select("place_id", "outer_group", "cluster")


@query(
    "supergroup_assignment",
    KMEANS
    + "SELECT image_id, first + cluster AS supergroup_id FROM img_placed JOIN labels USING (place_id) JOIN share USING (outer_group)",
)
def supergroup_assignment(spark, sf):
    placed = stage(placed_img(spark, sf), "placed").df
    vectors = stage(aggregate.place_embeddings(placed), "place_vectors").df
    out = supergroups.assign_supergroups(
        placed, vectors, size=2, spatial=2, angular=2, max_iter=3
    )
    return out.select("image_id", "supergroup_id")


# -- whole plans --------------------------------------------------------------------

GRID = replace(
    curation.BASE, cell_m=W.CELL_M, heading_deg=W.HEADING_DEG, min_images=15, supergroup_size=2
)


def _store(spark, sf):
    return W.img(spark, sf).select("source", "image_path", "embedding")


def _manifest(spark, sf):
    return W.img(spark, sf).drop("embedding")


CURATED = W.ctes(
    W.IMG, W.placed("img"), KEPT,
    "coded AS (SELECT image_id, dense_rank() OVER (ORDER BY place_id) - 1 AS place_id FROM kept)",
    """coded_img AS (SELECT c.image_id, c.place_id, i.cell_x, i.cell_y, i.cell_h, i.source, i.embedding FROM coded c JOIN img_placed i USING (image_id))""",
)
CURATED_GROUPS = CURATED.rstrip() + "," + list_sums("coded_img", "means", "place_id", agg="avg") + """,
place_vec AS (SELECT place_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS embedding FROM means)""" + "," + SHARE.format(
    view="coded_img", size=2
) + "," + _recursive_kmeans(curation.BASE.kmeans_iter) + "\n"


@query(
    "curated_train_set",
    CURATED_GROUPS
    + "SELECT image_id, place_id, first + cluster AS supergroup_id FROM coded_img JOIN labels USING (place_id) JOIN share USING (outer_group)",
)
def curated_train_set(spark, sf):
    """The single-source plan: places, filter, place vectors, supergroups."""
    out = curation.curate(_manifest(spark, sf), _store(spark, sf), GRID).images
    return out.select("image_id", "place_id", "supergroup_id")


@query(
    "curated_set_files",
    CURATED_GROUPS
    + """SELECT supergroup_id, count(DISTINCT place_id) AS num_places, max(place_id) AS last_place, count(*) AS num_images FROM (
    SELECT supergroup_id, dense_rank() OVER (PARTITION BY supergroup_id ORDER BY place_id) - 1 AS place_id FROM (
    SELECT image_id, place_id, first + cluster AS supergroup_id FROM coded_img JOIN labels USING (place_id) JOIN share USING (outer_group))) GROUP BY 1""",
)
def curated_set_files(spark, sf):
    """The plan with its saved set, summary and supergroup profile."""
    root = fresh(spark, "processed")
    curation.build_train_set(_manifest(spark, sf), _store(spark, sf), root, "single", GRID)
    return spark.read.parquet(f"{root}/train/single/images").groupBy("supergroup_id").agg(
        F.count_distinct("place_id").alias("num_places"), F.max("place_id").alias("last_place"),
        F.count("*").alias("num_images"),
    )


@query(
    "combined_train_set",
    CURATED.rstrip()
    + """,
touched AS (SELECT DISTINCT place_id FROM coded_img WHERE source = 'sf_xl'),
ranked AS (SELECT place_id, row_number() OVER (ORDER BY md5('42:' || CAST(place_id AS VARCHAR)), place_id) AS r FROM touched),
halved AS (SELECT * FROM coded_img WHERE source <> 'sf_xl' OR place_id IN (SELECT place_id FROM ranked WHERE r <= greatest(1, (SELECT count(*) FROM touched) // 2))),
coded2 AS (SELECT row_number() OVER (ORDER BY image_id) - 1 AS image_id, image_id AS old_id, dense_rank() OVER (ORDER BY place_id) - 1 AS place_id, source FROM halved),
touched2 AS (SELECT DISTINCT place_id FROM coded2 WHERE source = 'msls'),
ranked2 AS (SELECT place_id, row_number() OVER (ORDER BY md5('42:' || CAST(place_id AS VARCHAR)), place_id) AS r FROM touched2),
halved2 AS (SELECT * FROM coded2 WHERE source <> 'msls' OR place_id IN (SELECT place_id FROM ranked2 WHERE r <= greatest(1, (SELECT count(*) FROM touched2) // 2))),
halved3 AS (SELECT row_number() OVER (ORDER BY image_id) - 1 AS image_id, dense_rank() OVER (ORDER BY place_id) - 1 AS place_id, source, old_id FROM (
  SELECT h.image_id, h.place_id, h.source, c.old_id FROM halved2 h JOIN coded2 c USING (image_id))),
final_img AS (SELECT h.image_id, h.place_id, h.source, i.cell_x, i.cell_y, i.cell_h, i.embedding FROM halved3 h JOIN img_placed i ON i.image_id = h.old_id),
""" + list_sums("final_img", "means", "place_id", agg="avg").strip() + """,
place_vec AS (SELECT place_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS embedding FROM means),""" + SHARE.format(view="final_img", size=2)
    + "," + _recursive_kmeans(curation.BASE.kmeans_iter) + """
SELECT image_id, place_id, first + cluster AS supergroup_id, source FROM final_img JOIN labels USING (place_id) JOIN share USING (outer_group)""",
)
def combined_train_set(spark, sf):
    """Four sources with two of them halved, clustered."""
    params = replace(GRID, subsample=curation.COMBINED.subsample)
    out = curation.curate(_manifest(spark, sf), _store(spark, sf), params).images
    return out.select("image_id", "place_id", "supergroup_id", "source")


_VARIANTS = {k: replace(v, cell_m=W.CELL_M) for k, v in curation.VARIANTS.items()}


def _variant_sql(name: str, tau: float, grouped: bool) -> str:
    """A variant's images; there are fewer places than a cluster holds, so each outer group is one cluster."""
    group = "dense_rank() OVER (ORDER BY ((cell_x % 2) * 2 + cell_y % 2) * 2 + cell_h % 2) - 1" if grouped else "CAST(0 AS BIGINT)"
    kept = f"v{int(tau * 10)}" if tau > -1 else "(SELECT * FROM img_placed WHERE place_id IN (SELECT place_id FROM img_placed GROUP BY 1 HAVING count(*) >= 4))"
    return f"""SELECT '{name}' AS variant, image_id, dense_rank() OVER (ORDER BY place_id) - 1 AS place_id, {group} AS supergroup_id FROM {kept}"""


@query(
    "ablation_variants",
    W.ctes(W.IMG, W.placed("img"), *[filtered("img_placed", t, 4, f"v{int(t * 10)}") for t in TAUS])
    + " UNION ALL ".join(_variant_sql(n, p.tau, p.supergroup_size is not None) for n, p in _VARIANTS.items()),
)
def ablation_variants(spark, sf):
    """All eight variants with their own thresholds, supergroup sizes and steps, from one pass over the vectors."""
    made = curation.curate_variants(_manifest(spark, sf), _store(spark, sf), _VARIANTS)
    each = [c.images.select(F.lit(n).alias("variant"), "image_id", "place_id", "supergroup_id") for n, c in made.items()]
    return reduce(DataFrame.unionByName, each)
