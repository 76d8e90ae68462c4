"""A training corpus from raw documents, in stages.

Each stage's result is written as Parquet and read again as the next one's input, so a lost
executor costs no more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocurate.llm import bpe, decontaminate, dedup, ngram_join, quality
from geocurate.llm.common import table
from geocurate.runtime import stage

#: Rank file that the corpus is encoded by.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go; a fifth of the labels isn't learned from."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    ranking = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality.keep_good(docs, ranking)


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    return dedup.drop_copies(docs, dedup.DigestIndex.open(spark))


def drop_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more join, that with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a part of one, go."""
    return decontaminate.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; a text that they don't decode to fails the stage."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    coded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, checked=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality ranking", keep_quality),
    ("exact dedup", drop_equal_texts),
    ("n-gram Jaccard join", drop_similar_texts),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]

#: No SQL expresses the ranking, the edit distances and the merges; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_")).df
    return docs
