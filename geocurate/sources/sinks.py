"""Writing of datasets, summaries, embedding stores, reports and keyed stages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.operators import report as R
from geocurate.operators.ids import rank_in_group
from geocurate.runtime import path_exists, stage


def local_place_ids(df: DataFrame) -> DataFrame:
    """Number the places 0.. inside each supergroup, in order of their id."""
    table = rank_in_group(
        df.select("supergroup_id", "place_id").distinct(), ["supergroup_id"], ["place_id"], "_local"
    )
    return (
        df.join(table.select("supergroup_id", "place_id", "_local"), ["supergroup_id", "place_id"])
        .withColumn("place_id", F.col("_local")).drop("_local")
    )


def save_train(df: DataFrame, root: str, name: str, by_supergroup: bool = False) -> str:
    """Replace the stored training set; place numbers are local in the written copy."""
    path = f"{root}/train/{name}/images"
    out = local_place_ids(df) if "supergroup_id" in df.columns else df
    writer = out.write.mode("overwrite")
    if by_supergroup:
        writer = writer.partitionBy("supergroup_id")
    writer.parquet(path)
    return path


def _save_eval(df: DataFrame, root: str, split: str, name: str) -> str:
    path = f"{root}/{split}/{name}/images"
    if "matches" in df.columns:
        empty = F.array().cast(df.schema["matches"].dataType)
        df = df.withColumn("matches", F.coalesce("matches", empty))
    df.write.mode("overwrite").parquet(path)
    return path


def save_val(df: DataFrame, root: str, name: str) -> str:
    return _save_eval(df, root, "val", name)


def save_test(df: DataFrame, root: str, name: str) -> str:
    return _save_eval(df, root, "test", name)


def save_summary(summary: DataFrame, root: str, split: str, name: str, kind: str = "summary") -> str:
    path = f"{root}/{split}/{name}/{kind}"
    summary.write.mode("overwrite").json(path)
    return path


def save_image_embeddings(df: DataFrame, store: str, mode: str = "append") -> None:
    df.select("image_path", F.col("embedding").cast("array<float>").alias("embedding"), "source").write.mode(
        mode
    ).partitionBy("source").parquet(store)


def save_place_embeddings(df: DataFrame, store: str) -> None:
    df.select("place_id", "embedding").write.mode("overwrite").parquet(store)


def save_recall_report(results: DataFrame, path: str) -> str | None:
    """Write one report line per run; nothing is written without recall metrics."""
    rows = R.recall_rows(results)
    if rows.isEmpty():
        return None
    per_dataset = rows.groupBy("run", "dataset").agg(_map_of("metric", "value").alias("m"))
    metrics = per_dataset.groupBy("run").agg(_map_of("dataset", "m").alias("metrics"))
    average = R.recall_average(rows).groupBy("run").agg(_map_of("metric", "value").alias("average"))
    metrics.join(average, "run").withColumnRenamed("run", "checkpoint").write.mode("overwrite").json(path)
    return path


def _map_of(key: str, value: str):
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def redealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """*df* dealt anew by *keys* in *parts* partitions; Spark cuts those that are larger than a task's share."""
    return df.hint("rebalance", parts, *[F.col(k) for k in keys])


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive sum of row hashes."""
    row = F.xxhash64(*[F.to_json(c) if _is_map(df, c) else F.col(c) for c in df.columns])
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()


def stage_key(name: str, params: dict[str, Any], table: DataFrame) -> str:
    """Key of a stage: its name, its parameters and the content of its input."""
    content = fingerprint(table).first()
    text = json.dumps([name, params, table.schema.json(), content["rows"], content["digest"]], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def keyed_stage(
    table: DataFrame, name: str, params: dict[str, Any] | None, folder: str,
    step: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Result of *step*, reloaded if the same step already ran on the same content.

    A step without parameters is never stored.
    """
    if params is None:
        return table.transform(step)
    spark = table.sparkSession
    path = f"{folder}/{name}-{stage_key(name, params, table)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        table.transform(step).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def keyed_manifest(
    listing: DataFrame, source: str, params: dict[str, Any], folder: str,
    build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Manifest of a file listing, rebuilt only when the listing or a parameter changes."""
    return keyed_stage(listing, "manifest", {"source": source, **params}, folder, build)


def updated_manifest(
    listing: DataFrame, folder: str, parse: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("root", "path"),
) -> tuple[DataFrame, dict[str, int]]:
    """Parsed rows of a file listing (*keys*, length, modified), kept up to date in *folder*.

    Rows are stored with the length and time of their file.  Files that are there unchanged keep their row, only new and
    changed ones go through *parse* (which adds columns to them), and rows of files that are gone are
    left out.  An unchanged listing reads the stored version back and writes nothing.  Also returns how
    many files were kept, parsed and removed.  Rows have no numbers: number the result
    (`images.in_walk_order`), as every change shifts them.  One writer at a time.
    """
    spark = listing.sparkSession
    known, version = [*keys, "length", "modified"], 0
    while path_exists(spark, f"{folder}/v{version + 1}/_SUCCESS"):
        version += 1
    if not version:
        parsed = listing.transform(parse)
        parsed.write.mode("overwrite").parquet(f"{folder}/v1")
        rows = spark.read.parquet(f"{folder}/v1")
        return rows, {"kept": 0, "parsed": rows.count(), "removed": 0}
    before = spark.read.parquet(f"{folder}/v{version}")
    files = listing.select(*keys, F.struct(*listing.columns).alias("_file"))
    rows = before.select(*keys, F.struct("length", "modified").alias("_stored"))
    same = F.coalesce(
        (F.col("_file.length") == F.col("_stored.length")) & (F.col("_file.modified") == F.col("_stored.modified")), F.lit(False)
    )
    state = F.when(same, "kept").when(F.col("_file").isNull(), "removed").otherwise("parsed")
    # one join; of unchanged files only their number is written
    met = files.join(rows, list(keys), "full_outer").select(
        state.alias("state"), *[F.when(~same, F.col(k)).alias(k) for k in keys],
        F.when(state == "parsed", F.col("_file")).alias("_file"),
    )
    changed = stage(met, "changed_files")
    found = {r["state"]: r["n"] for r in changed.df.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {name: found.get(name, 0) for name in ("kept", "parsed", "removed")}
    if counts["parsed"] or counts["removed"]:
        version += 1
        fresh = changed.df.filter(F.col("state") == "parsed").select("_file.*")
        kept = before.join(changed.df.filter(F.col("state") != "kept").select(*keys), list(keys), "left_anti")
        kept.unionByName(fresh.transform(parse)).write.mode("overwrite").parquet(f"{folder}/v{version}")
        before = spark.read.parquet(f"{folder}/v{version}")
    changed.drop()
    return before, counts
