"""Distributions over all pairs of places of a supergroup, without forming pairs.

Every statistic is exact.  A pair of blocks returns partial aggregates: moments,
histogram counts, or counts by leading bits of the value for the median.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.operators import blocks as B
from geocurate.runtime import Stage, arrow_rows, stage

_DIGIT_BITS = 16


def place_blocks(
    places: DataFrame, group: str = "supergroup_id", vectors: bool = False, rows: int | None = None
) -> Stage:
    """Place centroids (and vectors) packed per group; written once, read by each pass."""
    values = ["utm_east", "utm_north"] + (["embedding"] if vectors else [])
    dim = B.vector_size(places, "embedding") if vectors else 2
    packed = B.pack(places, [group], "place_id", values, rows or B.rows_per_block(dim))
    return stage(packed, "place_blocks")


def _values(row: dict, kind: str) -> np.ndarray:
    left, right = B.fields(row["left"]), B.fields(row["right"])
    if kind == "distance":
        de = B.column(left, "utm_east")[:, None] - B.column(right, "utm_east")[None, :]
        dn = B.column(left, "utm_north")[:, None] - B.column(right, "utm_north")[None, :]
        table = np.sqrt(de * de + dn * dn)
    else:
        table = B.unit_rows(B.matrix(left, "embedding")) @ B.unit_rows(B.matrix(right, "embedding")).T
    if row["i"].as_py() == row["j"].as_py():
        return table[np.triu_indices(len(table), k=1)]
    return table.ravel()


def _run(pairs: DataFrame, group: str, fn, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    schema = pa.schema([(group, pa.int64()), *fields])

    def with_group(row: dict) -> dict | None:
        result = fn(row)
        if result is None:
            return None
        length = len(next(iter(result.values())))
        return {group: np.full(length, row[group].as_py()), **result}

    return pairs.mapInArrow(B.per_row(with_group, schema), f"{group} long, {ddl}")


def pair_moments(
    blocks: Stage, group: str = "supergroup_id", kind: str = "distance", threshold: float = 25.0
) -> DataFrame:
    """Pairs, min, max, mean, population deviation and count below *threshold*."""

    def moments(row: dict) -> dict | None:
        x = _values(row, kind)
        if not len(x):
            return None
        mean = x.mean()
        return {
            "n": [len(x)], "low": [x.min()], "high": [x.max()], "mean": [mean],
            "m2": [((x - mean) ** 2).sum()], "under": [int((x < threshold).sum())],
        }

    part = _run(
        B.pair_up(blocks.df, [group]), group, moments,
        [("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()),
         ("mean", pa.float64()), ("m2", pa.float64()), ("under", pa.int64())],
        "n long, low double, high double, mean double, m2 double, under long",
    )
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / F.sum("n")
    out = part.groupBy(group).agg(
        F.sum("n").alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high"),
        grand.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), spread - grand * grand)).alias("std"),
        F.sum("under").alias("under_threshold"),
    )
    with arrow_rows(blocks.df.sparkSession, B.BATCH_BLOCKS):
        return stage(out, "pair_moments").df


def pair_histogram(
    blocks: Stage, moments: DataFrame, group: str = "supergroup_id",
    kind: str = "distance", bins: int = 60,
) -> DataFrame:
    """(group, bin, count): *bins* equal bins over [min, max], the last one closed."""

    def count(row: dict) -> dict | None:
        x = _values(row, kind)
        low, high = row["low"].as_py(), row["high"].as_py()
        if not len(x):
            return None
        n = np.bincount(_bin(x, low, high, bins), minlength=bins)
        used = np.flatnonzero(n)
        return {"bin": used, "count": n[used]}

    limits = moments.select(group, "low", "high")
    pairs = B.pair_up(blocks.df.join(limits, group), [group], carry=["low", "high"])
    part = _run(pairs, group, count, [("bin", pa.int32()), ("count", pa.int64())], "bin int, count long")
    with arrow_rows(blocks.df.sparkSession, B.BATCH_BLOCKS):
        return stage(part.groupBy(group, "bin").agg(F.sum("count").alias("count")), "pair_histogram").df


def _bin(x: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    if high <= low:
        return np.zeros(len(x), dtype=np.int64)
    return np.minimum(np.floor((x - low) / (high - low) * bins).astype(np.int64), bins - 1)


def pair_median(
    blocks: Stage, moments: DataFrame, group: str = "supergroup_id", kind: str = "distance"
) -> DataFrame:
    """Exact median of the non-negative pair values of each group.

    A non-negative double orders like its bit pattern, so the middle values are found
    16 bits at a time: four passes that return counts by the next digit among pairs
    that share the digits found so far.  An even count averages two middle values.
    """
    spark = blocks.df.sparkSession
    sides = F.array((F.col("pairs") - 1) / 2, F.col("pairs") / 2)
    targets = moments.select(
        group,
        F.posexplode(F.transform(sides, lambda r: F.floor(r).cast("long"))).alias("side", "skip"),
    ).withColumn("prefix", F.lit(0).cast("long"))
    for step in range(4):
        known_shift = 64 - _DIGIT_BITS * step
        shift = known_shift - _DIGIT_BITS
        wanted = targets.groupBy(group).agg(F.sort_array(F.collect_set("prefix")).alias("prefixes"))

        def digits(row: dict, known_shift=known_shift, shift=shift) -> dict | None:
            bits = np.ascontiguousarray(_values(row, kind)).view(np.uint64)
            out_p, out_d, out_n = [], [], []
            for prefix in row["prefixes"].as_py():
                same = bits if known_shift == 64 else bits[(bits >> np.uint64(known_shift)) == np.uint64(prefix)]
                digit, n = np.unique((same >> np.uint64(shift)) & np.uint64(0xFFFF), return_counts=True)
                out_p.append(np.full(len(digit), prefix))
                out_d.append(digit.astype(np.int64))
                out_n.append(n)
            return {
                "prefix": np.concatenate(out_p).astype(np.int64),
                "digit": np.concatenate(out_d), "n": np.concatenate(out_n),
            }

        pairs = B.pair_up(blocks.df.join(wanted, group), [group], carry=["prefixes"])
        counts = _run(
            pairs, group, digits,
            [("prefix", pa.int64()), ("digit", pa.int64()), ("n", pa.int64())],
            "prefix long, digit long, n long",
        ).groupBy(group, "prefix", "digit").agg(F.sum("n").alias("n"))
        # at most 65536 digits per target, whatever the number of pairs
        steps = targets.join(counts, [group, "prefix"]).groupBy(group, "side", "skip", "prefix").agg(
            F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("ladder")
        )
        found = F.aggregate(
            "ladder",
            F.struct(F.col("skip").alias("left"), F.lit(-1).cast("long").alias("digit")),
            lambda acc, x: F.when(acc["digit"] >= 0, acc)
            .when(acc["left"] < x["n"], F.struct(acc["left"].alias("left"), x["digit"].alias("digit")))
            .otherwise(F.struct((acc["left"] - x["n"]).alias("left"), acc["digit"].alias("digit"))),
        )
        picked = steps.withColumn("_f", found).select(
            group, "side", F.col("_f.left").alias("skip"),
            (F.shiftleft("prefix", _DIGIT_BITS) + F.col("_f.digit")).alias("prefix"),
        )
        with arrow_rows(spark, B.BATCH_BLOCKS):
            targets = stage(picked, "median_digits").df
    return targets.groupBy(group).agg(F.avg(_bits_to_double(F.col("prefix"))).alias("median"))


def _bits_to_double(bits):
    """The double with the given non-negative bit pattern, by IEEE-754 arithmetic."""
    exponent = F.shiftright(bits, 52)
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1))
    normal = (fraction + F.lit(1 << 52)).cast("double") * F.pow(F.lit(2.0), exponent.cast("double") - 1075)
    tiny = fraction.cast("double") * F.pow(F.lit(2.0), F.lit(-1074.0))
    return F.when(exponent == 0, tiny).otherwise(normal)


def value_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, count) of one column: equal bins over [min, max], the last one closed.

    The column is written once: a sum that is taken again may add its rows in another order, and a lowest
    value that differs in its last bit would leave the first bin.
    """
    df = stage(df.select(column), "histogram_values").df
    low = df.agg(F.min(column).cast("double")).scalar()
    high = df.agg(F.max(column).cast("double")).scalar()
    position = F.floor((F.col(column) - low) / (high - low) * bins)
    index = F.when(high > low, F.least(position, F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    )


def row_profile(images: DataFrame, group: str = "place_id", rows: int | None = None) -> DataFrame:
    """Per image: lowest, mean and highest cosine to the other images of its group.

    These are the row statistics of the similarity matrix of each place; the matrix
    itself is returned for chosen places by :func:`similarity_matrix`.
    """

    def profile(row: dict) -> dict:
        left, right, sim, other = _similarities(row)
        n = other.sum(axis=1)
        return {
            "image_id": B.column(left, "id"), "n": n,
            "low": np.where(other, sim, np.inf).min(axis=1),
            "total": np.where(other, sim, 0.0).sum(axis=1),
            "high": np.where(other, sim, -np.inf).max(axis=1),
        }

    rows = rows or B.rows_per_block(B.vector_size(images, "embedding"))
    blocks = stage(B.pack(images, [group], "image_id", ["embedding"], rows), "image_blocks")
    part = _run(
        B.pair_up(blocks.df, [group], ordered=True), group, profile,
        [("image_id", pa.int64()), ("n", pa.int64()), ("low", pa.float64()),
         ("total", pa.float64()), ("high", pa.float64())],
        "image_id long, n long, low double, total double, high double",
    )
    out = part.groupBy(group, "image_id").agg(
        F.min("low").alias("low"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.max("high").alias("high"), F.sum("n").alias("_n"),
    ).filter(F.col("_n") > 0).drop("_n")
    with arrow_rows(images.sparkSession, B.BATCH_BLOCKS):
        result = stage(out, "row_profile").df
    blocks.drop()
    return result


def similarity_matrix(images: DataFrame, place_ids: list[int], rows: int | None = None) -> DataFrame:
    """Cosine matrix of the named places: (place_id, image_id, others, similarities).

    A row of the matrix comes in parts of at most one block.
    """

    def lines(row: dict) -> dict:
        left, right, sim, _ = _similarities(row)
        others = B.column(right, "id")
        return {
            "image_id": B.column(left, "id"), "others": [others] * len(sim), "similarities": list(sim),
        }

    chosen = images.filter(F.col("place_id").isin(*place_ids))
    rows = rows or B.rows_per_block(B.vector_size(images, "embedding"))
    blocks = stage(B.pack(chosen, ["place_id"], "image_id", ["embedding"], rows), "image_blocks")
    out = _run(
        B.pair_up(blocks.df, ["place_id"], ordered=True), "place_id", lines,
        [("image_id", pa.int64()), ("others", pa.list_(pa.int64())), ("similarities", pa.list_(pa.float64()))],
        "image_id long, others array<long>, similarities array<double>",
    )
    with arrow_rows(images.sparkSession, B.BATCH_BLOCKS):
        return stage(out, "similarity_matrix").df


def _similarities(row: dict):
    left, right = B.fields(row["left"]), B.fields(row["right"])
    sim = B.unit_rows(B.matrix(left, "embedding"), 1e-12) @ B.unit_rows(B.matrix(right, "embedding"), 1e-12).T
    other = B.column(left, "id")[:, None] != B.column(right, "id")[None, :]
    return left, right, sim, other
