"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text.  New
data is reduced to its digests, compared with the index by a sort-merge anti-join and
what is new is appended.  Only digests move between tasks, never texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.llm.common import join_lookup
from geocurate.runtime import path_exists, shared_dir, stage

#: Fixed value: the white space that a text's normal form folds to one space.
SPACES = r"[\x20\x09-\x0D]+"


def normal_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


@dataclass
class DigestIndex:
    """Rows (digest BINARY, keep_id), bucketed and sorted by digest, at a path that outlives the session."""

    spark: SparkSession
    name: str
    path: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """The index at *path*, made empty if there is none; without *path* a new one in the shared folder.

        The number of buckets is fixed when the index is made and must be repeated later;
        a new index gets as many as the session has shuffle partitions.
        """
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"digest_index_{uuid.uuid4().hex}"
        path = path or f"{shared_dir(spark)}/{name}"
        existed = path_exists(spark, path)
        spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if existed:
            spark.catalog.refreshTable(name)
        return cls(spark, name, path, buckets)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Add rows whose digests the index doesn't hold; each task writes one bucket, sorted."""
        (
            fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .mode("append").option("path", self.path).saveAsTable(self.name)
        )


def dedup(new: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for each row of *new* whether it stays, and append the digests it brings to *index*.

    Returns one row per input row: the id, ``keep_id`` (the id of the row that stays: of an
    equal text that the index already holds, else the smallest id of the equal texts in
    *new*), ``group_size`` (equal texts in *new*), ``kept`` and ``text_sha256``.

    Texts are equal when their digests are.  A null text counts as empty, and empty texts
    are a group like any other.  A row with a null id never stays and is counted in its
    group; a group of such rows alone has a null ``keep_id`` and isn't indexed, so that it
    never hides a later row.  A row that repeats both id and text of the one that stays is
    marked like it.  An empty table appends nothing.  Other columns of *new* are not read,
    so they may have any name.

    A group may hold any share of the rows: counts are summed before the shuffle, and the
    join back broadcasts the groups that are large (`common.join_lookup`).
    """
    hashed = stage(
        new.select(F.col(id_col).alias("_id"), F.unhex(normal_digest(F.col(text_col))).alias("digest")), "digests"
    ).df
    groups = stage(
        hashed.groupBy("digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("group_size")), "digest_groups"
    ).df
    fresh = groups.filter("_first IS NOT NULL").join(index.df.hint("merge"), "digest", "left_anti")
    fresh = stage(fresh.select("digest", F.col("_first").alias("keep_id")), "fresh_digests").df
    known = index.df.hint("merge").join(groups.select("digest"), "digest", "left_semi")
    keepers = stage(
        groups.join(fresh.unionByName(known).hint("merge"), "digest", "left")
        .select("digest", "keep_id", "group_size"),
        "keepers",
    ).df
    index.append(fresh)
    return join_lookup(hashed, keepers, "digest", "group_size").select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* that stay, with all their columns, in any order."""
    kept = dedup(docs, index, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, F.col(id_col) == F.col("_kept_id"), "left_semi")
