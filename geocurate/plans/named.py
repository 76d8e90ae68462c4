"""The published sets by name: what is read, embedded, curated and saved for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from geocurate.operators import embed, places
from geocurate.plans import curation
from geocurate.sources import cities, images, tables

# Folders of queries and database below the raw folder.
VAL_SETS = {
    "pitts30k_val": ("pitts30k/images/val/queries", "pitts30k/images/val/database"),
    "sf_xl_small_val": ("sf_xl/small/val/queries", "sf_xl/small/val/database"),
    "sf_xl_val": ("sf_xl/processed/val/queries", "sf_xl/processed/val/database"),
    "msls_val": ("msls/val/queries", "msls/val/database"),
    "svox_val": ("svox/images/val/queries", "svox/images/val/gallery"),
}
TEST_SETS = {
    "pitts30k_test": ("pitts30k/images/test/queries", "pitts30k/images/test/database"),
    "tokyo247_test": ("tokyo247/images/test/queries", "tokyo247/images/test/database"),
    "sf_xl_small_test": ("sf_xl/small/test/queries_v1", "sf_xl/small/test/database"),
    "sf_xl_test": ("sf_xl/processed/test/queries_v1", "sf_xl/processed/test/database"),
    "nordland_test": ("nordland/images/test/queries", "nordland/images/test/database"),
    "svox_test": ("svox/images/test/queries", "svox/images/test/gallery"),
    "eynsham_test": ("eynsham/images/test/queries", "eynsham/images/test/database"),
}
# Sources of training sets, by name, and where each lies below the raw folder.
SOURCES = {
    "gsvcities": "gsvcities",
    "sf_xl": "sf_xl/processed/train",
    "pitts30k": "pitts30k/images/train",
    "msls": "msls/train",
}
CITY_FILES = "Dataframes"
COMBINED_SOURCES = ("gsvcities", "sf_xl", "pitts30k", "msls")

Loader = Callable[[], embed.Model]


def build_eval(spark: SparkSession, raw: str, root: str, name: str) -> DataFrame:
    """Read, match and save the evaluation set of that name."""
    split = "val" if name in VAL_SETS else "test"
    queries, database = (VAL_SETS | TEST_SETS)[name]
    manifest = images.read_eval(spark, f"{raw}/{queries}", f"{raw}/{database}", raw)
    return curation.build_eval_set(manifest, root, split, name)


def read_source(spark: SparkSession, raw: str, source: str) -> DataFrame:
    """Manifest of one training source."""
    folder = f"{raw}/{SOURCES[source]}"
    if source == "gsvcities":
        return cities.read_cities(spark, f"{folder}/{CITY_FILES}", image_root=folder, base=raw)
    if source == "pitts30k":
        return images.read_pitts(spark, [folder], raw)
    return images.read_named(spark, [folder], source, raw)


def _embedded(
    spark: SparkSession, raw: str, store: str, sources: list[str], load_model: Loader, batch_size: int
) -> tuple[DataFrame, DataFrame]:
    """Manifest of the sources, and their vectors once what the store lacks is embedded."""
    parts = [read_source(spark, raw, source) for source in sources]
    manifest = parts[0] if len(parts) == 1 else places.combine(parts)
    for source in sources:
        embed.embed_missing(manifest, store, source, load_model, batch_size)
    return manifest, tables.load_embeddings(spark, store, *(sources if len(sources) == 1 else ()))


def build_train(
    spark: SparkSession, raw: str, root: str, store: str, name: str, sources: Iterable[str],
    load_model: Loader, params: curation.CurationParams = curation.BASE, batch_size: int = 128,
) -> curation.Curated:
    """The whole plan: read the sources, embed what the store lacks, curate, save and profile."""
    manifest, vectors = _embedded(spark, raw, store, list(sources), load_model, batch_size)
    return curation.build_train_set(manifest, vectors, root, name, params)


def build_combined(spark: SparkSession, raw: str, root: str, store: str, load_model: Loader) -> curation.Curated:
    """The set of four sources, of which two are halved."""
    return build_train(
        spark, raw, root, store, "_".join(COMBINED_SOURCES) + "_train",
        COMBINED_SOURCES, load_model, curation.COMBINED,
    )


def build_variants(
    spark: SparkSession, raw: str, root: str, store: str, load_model: Loader,
    names: Iterable[str] = tuple(curation.VARIANTS), batch_size: int = 128,
) -> dict[str, curation.Curated]:
    """Variants of the single-source set: read, embedded and put in order once for all of them."""
    manifest, vectors = _embedded(spark, raw, store, ["sf_xl"], load_model, batch_size)
    params = {name: curation.VARIANTS[name] for name in names}
    made = curation.curate_variants(manifest, vectors, params)
    for name, result in made.items():
        curation.save_train_set(result, root, f"sf_xl_{name}", params[name])
    return made
