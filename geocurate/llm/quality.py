"""Quality by pairwise ranking: a Bradley-Terry model over surface features of the whole text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocurate.llm import linear

#: A document keeps its place in the corpus from this score on.
KEEP_FROM = 0.3
#: Better documents that each worse one is compared with.
RIVALS = 8

FEATURES = (
    "log_words", "letters", "capitals", "digits", "symbols", "bars", "marks", "stops", "long_words", "word_length",
    "repeats", "distinct", "top_word", "line_repeats", "words_a_line",
)

#: Byte classes: every byte of a letter outside ASCII counts as a letter.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in " \t\n\r\v\f"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[ord("|")] = 7


def describe(text: str | None) -> list[float]:
    """The features of one whole text; zeros for a null or empty one."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    n, solid = len(words), len(raw) - counts[4]
    tally = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        math.log1p(n),
        counts[1] / solid, counts[2] / solid, counts[3] / solid, counts[0] / solid, counts[7] / n, counts[6] / n, counts[5] / n,
        sum(len(w) > 24 for w in tally) / len(tally),
        min(solid / n, 30.0),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        math.log(len(tally)) / math.log(n) if n > 1 else 1.0,
        max(tally.values()) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
    ]


def features(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``features``, an array of `FEATURES`; all other columns stay, the texts only if asked for.

    A column that already has that name is replaced.
    """
    kept = [c for c in docs.columns if c != "features" and (keep_text or c != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([describe(t.as_py()) for t in batch.column(text_col)], np.float64).reshape(-1, len(FEATURES))
            offsets = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
            arrays = [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(offsets, rows.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "features"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


@dataclass(frozen=True)
class Ranking:
    """Scores of the ranking, and the score at the quantile that parts worse from better."""

    model: linear.Linear
    threshold: float

    def score(self, described: DataFrame) -> Column:
        """0 to 1; `KEEP_FROM` at the threshold."""
        raw = self.model.column([described["features"][i] for i in range(len(FEATURES))])
        return linear.sigmoid(raw - self.threshold + math.log(KEEP_FROM / (1 - KEEP_FROM)))


def fit(sample: DataFrame, ridge: float = 1.0) -> Ranking:
    """Fit to a bounded *sample* of rows (features, _label), of which only numbers reach the driver.

    Every worse document is paired with `RIVALS` better ones, spread evenly; a pair's loss
    is logistic in the difference of their features.  The threshold is the quantile of the
    sample's scores that leaves below it the share of worse documents.  Without both
    labels there is no preference: all weights are zero and every document stays.
    """
    rows = sample.select("features", "_label").collect()
    x = np.array([r[0] for r in rows], np.float64).reshape(-1, len(FEATURES))
    y = np.array([r[1] for r in rows], np.int64)
    worse, better = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    if not len(worse) or not len(better):
        return Ranking(linear.Linear((0.0,) * len(FEATURES), 0.0), 0.0)
    mean, scale = linear.scaling(x)
    z = (x - mean) / scale
    order = np.lexsort((*z.T,))  # whatever order the rows came in
    worse, better = [group[np.argsort(np.argsort(order)[group])] for group in (worse, better)]
    left = np.repeat(worse, RIVALS)
    right = better[(np.arange(len(left)) * 7919) % len(better)]
    w = linear.logistic(z[right] - z[left], np.ones(len(left)), ridge)
    model = linear.Linear.of_scaled(w, mean, scale)
    scores = np.sort(model.values(x))
    low, high = scores[len(worse) - 1], scores[min(len(worse), len(scores) - 1)]
    return Ranking(model, float((low + high) / 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Learn from the rows of *labels* with a ``quality``, at most `linear.FIT_ROWS` of them."""
    return fit(features(linear.labelled_sample(docs.select(id_col, text_col), labels, "quality", id_col), text_col))


def rate(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` to the columns other than the text.

    Null and empty texts get the score of zero features.  Rows are independent, so repeated
    rows, hot sources and text lengths make no difference; an empty table stays empty.
    """
    described = features(docs, text_col)
    scored = described.withColumn("score", ranking.score(described)).drop("features")
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of *docs* that the ranking doesn't reject, with their columns, in one pass and without a join."""
    described = features(docs, text_col, keep_text=True)
    return described.filter(ranking.score(described) >= KEEP_FROM).select(*docs.columns)
