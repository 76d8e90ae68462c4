"""Exact shortlists by Hamming distance from tables of substrings.

Codes that differ in at most r bits agree in one of m parts up to r // m bits.  So the parts of all
database codes are stored once, bucketed by (part, value), and a query looks up its own parts, then those with one
bit turned, then two, until the k-th best candidate is closer than anything not looked up
can be.  Each round costs look-ups, not a scan; queries that are settled take no further part.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geocurate.functions import vectors as V
from geocurate.operators import blocks as B
from geocurate.runtime import stage


@dataclass
class Substrings:
    """Rows (part, value, database_id, code), bucketed by part and value; serves any number of searches."""

    table: B.BlockTable
    width: int
    bits: int
    rows: int

    @property
    def parts(self) -> int:
        return -(-self.width // self.bits)

    def drop(self) -> None:
        self.table.drop()


def _substrings(code: Column, width: int, bits: int) -> Column:
    """The parts of a packed code, lowest first; the last may be shorter."""
    part = lambda i: F.shiftrightunsigned(F.get(code, F.lit(i * bits // 64)), i * bits % 64).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return F.array(*[part(i) for i in range(-(-width // bits))])


def build(database: DataFrame, width: int, bits: int = 16, code: str = "code", id_col: str = "image_id") -> Substrings:
    """Store the parts of all codes of *width* bits; *bits* of a part divide 64 and should be near the logarithm of the rows."""
    if 64 % bits or not 0 < bits <= 16:
        raise ValueError(f"parts of {bits} bits")
    each = database.select(
        F.posexplode(_substrings(F.col(code), width, bits)).alias("part", "value"), F.col(id_col).alias("database_id"), F.col(code).alias("code")
    )
    return Substrings(B.BlockTable.write(each, ["part", "value"], "substrings"), width, bits, database.count())


def shortlist(index: Substrings, queries: DataFrame, k: int, code: str = "code", id_col: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """The k nearest codes of each query, ties to the smaller id: (query_id, database_id, differing, rank).

    The same rows as a full scan gives.  Also returns a row per round (turned, queries, candidates): the bits turned,
    the queries that were open, and the different codes that the round brought within their bounds.
    """
    spark = queries.sparkSession
    k = min(k, index.rows)
    best_kind = "query_id long, database_id long, differing int, rank int"
    rounds, best = [], None
    state = stage(queries.select(F.col(id_col).alias("query_id"), F.col(code).alias("own"), F.lit(index.width).alias("bound")), "open_queries").df
    for turned in range(index.bits + 1):
        n = state.count()
        if not n or not k:
            break
        masks = F.array(*[F.lit(sum(1 << b for b in some)).cast("long") for some in combinations(range(index.bits), turned)])
        probes = (
            state.select("query_id", "own", "bound", F.posexplode(_substrings(F.col("own"), index.width, index.bits)).alias("part", "at"))
            .select("query_id", "own", "bound", "part", "at", F.explode(masks).alias("mask"))
            .select("query_id", "own", "bound", "part", F.col("at").bitwiseXOR(F.col("mask")).alias("value"))
        )
        met = probes.join(index.table.df, ["part", "value"]).select("query_id", "database_id", "bound", V.hamming(F.col("own"), F.col("code")).alias("differing"))
        found = stage(met.filter("differing <= bound").select("query_id", "database_id", "differing").distinct(), "candidates").df
        rounds.append((turned, n, found.count()))
        both = found if best is None else found.unionByName(best.select("query_id", "database_id", "differing")).distinct()
        order = Window.partitionBy("query_id").orderBy("differing", "database_id")
        best = stage(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "nearest_codes").df
        # whatever wasn't looked up differs in turned + 1 bits of every part at least
        certain = index.parts * (turned + 1) - 1
        last = best.filter(F.col("rank") == k).select("query_id", F.col("differing").alias("last"))
        state = stage(
            state.join(last, "query_id", "left").filter(F.col("last").isNull() | (F.col("last") > certain))
            .select("query_id", "own", F.coalesce("last", "bound").alias("bound")),
            "open_queries",
        ).df
    report = spark.createDataFrame(rounds, "turned int, queries long, candidates long")
    return (spark.createDataFrame([], best_kind) if best is None else best), report
