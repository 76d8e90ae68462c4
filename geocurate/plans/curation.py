"""Named data plans: curated training sets, evaluation sets and evaluation runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.operators import (
    aggregate, blocks, coherence, elimination, embed, matches, places, profile, retrieval, supergroups,
)
from geocurate.operators.checks import require_heading, require_vectors
from geocurate.runtime import Stage, arrow_rows, dropping_stages, stage
from geocurate.sources import sinks


@dataclass(frozen=True)
class CurationParams:
    """Parameters of a training set.  ``tau = -1`` keeps every image."""

    cell_m: float = 12.5
    heading_deg: float | None = 60.0
    tau: float = 0.3
    min_images: int = 4
    supergroup_size: int | None = 1024
    spatial: int = 2
    angular: int = 2
    kmeans_iter: int = 100
    seed: int = 42
    subsample: tuple[tuple[str, float], ...] = ()


# Parameters of the published variants of the single-source set.
BASE = CurationParams()
VARIANTS = {
    "full": BASE,
    "raw_gps": replace(BASE, tau=-1.0, supergroup_size=None),
    "sg_only": replace(BASE, tau=-1.0),
    "filter_only": replace(BASE, supergroup_size=None),
    "tau02": replace(BASE, tau=0.2),
    "tau04": replace(BASE, tau=0.4),
    "sg512": replace(BASE, supergroup_size=512),
    "sg2048": replace(BASE, supergroup_size=2048),
}
COMBINED = replace(BASE, subsample=(("sf_xl", 0.5), ("msls", 0.5)))

# Match radius of evaluation sets.
MATCH_RADIUS_M = 25


@dataclass
class Curated:
    images: DataFrame
    place_vectors: DataFrame


def curate(images: DataFrame, store: DataFrame, params: CurationParams = BASE) -> Curated:
    """Places, coherence filter, optional subsampling, place vectors and supergroups.

    The vectors are joined from the store once and shuffled once by place; what is
    written between the steps is the narrow manifest and one vector per place.  The
    length of a vector comes from one row of the store, the sizes of places from the
    manifest.  Only subsampling after the filter, which can thin out a place, averages again.
    With ``tau`` of -1 or less nothing is filtered and no vector leaves the JVM.
    """
    with dropping_stages(images.sparkSession) as kept:
        placed = _placed(images, params)
        filtered = params.tau > -1
        if filtered:
            rows = coherence.staged_filter(
                embed.attach(placed, store), tau=params.tau, min_images=params.min_images,
                place_mean=not params.subsample, manifest=placed, width=blocks.vector_size(store, "embedding"),
            )
        else:  # no mean cosine is below -1
            rows = places.min_images(placed, params.min_images)
        rows, vectors = _kept(rows, store, params, filtered and not params.subsample)
        grouped = _grouped(rows, vectors.df, params)
        kept += [grouped, vectors]
    return Curated(grouped.df, vectors.df)


def curate_variants(images: DataFrame, store: DataFrame, variants: Mapping[str, CurationParams]) -> dict[str, Curated]:
    """:func:`curate` for several variants, each with the result it has alone, reading the vectors once.

    Variants on the same grid share one order of drops (:mod:`elimination`), recorded up to their largest
    threshold together with the place means at every threshold; a variant is a filter on that table, and variants that
    differ in their supergroups alone share its result.  Only those that subsample read the vectors again.
    """
    grids: dict[tuple, dict[str, CurationParams]] = {}
    for name, params in variants.items():
        grids.setdefault((params.cell_m, params.heading_deg), {})[name] = params
    out = {}
    with dropping_stages(images.sparkSession) as kept:
        for some in grids.values():
            placed = _placed(images, next(iter(some.values())))
            taus = sorted({max(p.tau, -1.0) for p in some.values()})
            with arrow_rows(images.sparkSession, 512):
                order = stage(
                    elimination.elimination(
                        embed.attach(placed, store), taus, place_means=True, manifest=placed,
                        width=blocks.vector_size(store, "embedding"),
                    ),
                    "elimination",
                ).df
            shared: dict[CurationParams, tuple[DataFrame, Stage]] = {}
            for name, params in some.items():
                same = replace(params, supergroup_size=None, spatial=0, angular=0, kmeans_iter=0)
                if same not in shared:
                    at = taus.index(max(params.tau, -1.0))
                    rows = places.min_images(elimination.survivors(order, params.tau), params.min_images)
                    rows = rows.withColumn("place_mean", F.get("place_means", F.lit(at))).drop("place_means", "step", "reach")
                    shared[same] = _kept(rows.drop("place_mean") if params.subsample else rows, store, params, not params.subsample)
                rows, vectors = shared[same]
                grouped = _grouped(rows, vectors.df, params)
                kept += [grouped, vectors]
                out[name] = Curated(grouped.df, vectors.df)
    return {name: out[name] for name in variants}


def _placed(images: DataFrame, params: CurationParams) -> DataFrame:
    if params.heading_deg is not None and "place_id" not in images.columns:
        require_heading(images, "curation")
    return stage(places.assign_places(images, params.cell_m, params.heading_deg), "placed").df


def _kept(rows: DataFrame, store: DataFrame, params: CurationParams, carried: bool) -> tuple[DataFrame, Stage]:
    """Stored images with places numbered anew, and place vectors, from the images that are kept.

    *carried*: the first image of each place has its ``place_mean``.  Other stages are left to the caller.
    """
    rows = places.refactorize(rows)
    for source, fraction in params.subsample:
        rows = places.subsample_source_places(rows, source, fraction, params.seed)
    rows = stage(rows, "kept").df
    means = aggregate.carried_embeddings(rows) if carried else aggregate.place_embeddings(embed.attach(rows, store))
    return rows.drop("place_mean"), stage(means, "place_vectors")


def _grouped(rows: DataFrame, vectors: DataFrame, params: CurationParams) -> Stage:
    if params.supergroup_size is None:
        grouped = places.uniform_supergroup(rows)
    else:
        grouped = supergroups.assign_supergroups(
            rows, vectors, params.supergroup_size, params.spatial, params.angular,
            params.kmeans_iter, params.seed,
        )
    return stage(grouped, "curated")


def build_train_set(
    images: DataFrame, store: DataFrame, root: str, name: str, params: CurationParams = BASE
) -> Curated:
    """Curate, save, and write the summary, the analysis and the profile of supergroups."""
    result = curate(images, store, params)
    save_train_set(result, root, name, params)
    return result


def save_train_set(result: Curated, root: str, name: str, params: CurationParams) -> None:
    """The set with its summary, its analysis, and the statistics and histograms of its supergroups."""
    sinks.save_train(result.images, root, name)
    save = lambda table, kind="summary": sinks.save_summary(table, root, "train", name, kind)
    save(profile.train_summary(result.images))
    save(profile.supergroup_stats(result.images), "supergroups")
    save(profile.source_stats(result.images), "sources")
    save(profile.analysis(result.images), "analysis")
    if params.supergroup_size is not None:
        centroids = stage(profile.place_centroids(result.images), "centroids").df
        quality = profile.supergroup_quality(centroids, result.place_vectors)
        save(quality, "supergroup_quality")
        save(profile.supergroup_geo_stats(centroids), "supergroup_geo")
        save(profile.supergroup_histograms(centroids, result.place_vectors, quality), "supergroup_histograms")


def build_eval_set(
    images: DataFrame, root: str, split: str, name: str, radius_m: float = MATCH_RADIUS_M
) -> DataFrame:
    """Ground truth by radius, saved with its summary."""
    matched = stage(matches.add_matches(images, radius_m), "matched").df
    save = sinks.save_val if split == "val" else sinks.save_test
    save(matched, root, name)
    sinks.save_summary(profile.eval_summary(matched), root, split, name)
    return matched


def evaluate(matched: DataFrame, vectors: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall@k of a stored evaluation set for vectors keyed by image_id.

    Every image of the set needs exactly one vector, so no query leaves the denominator.  The vectors are
    joined once; the sides, their sizes and the width are read from what that join wrote.
    """
    require_vectors(matched, vectors, ["image_id"], "evaluation")
    keyed = stage(matched.select("image_id", "is_query").join(vectors.select("image_id", "embedding"), "image_id"), "evaluated").df
    queries = keyed.filter("is_query").select("image_id", "embedding")
    database = keyed.filter("not is_query").select("image_id", "embedding")
    neighbours = retrieval.knn(queries, database, max(ks))
    return retrieval.recall_at(neighbours, matches.gold_pairs(matched), queries, database, ks)
