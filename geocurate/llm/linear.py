"""Small linear models: fitted on a bounded sample of feature rows, applied as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows a model is fitted on; those with the smallest hash of their id are taken.
FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most *rows* rows of *docs* with their label as ``_label``: those with the smallest hash of the id.

    Rows without id or label are left out.  An id with several labels takes the largest,
    so repeated rows of *labels* change nothing.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(rows)
    )
    return docs.join(F.broadcast(chosen), id_col)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights that minimise the logistic loss of ``x @ w`` plus a ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Linear:
    """Score ``bias + sum of weight * feature`` for raw features."""

    weights: tuple[float, ...]
    bias: float

    @classmethod
    def of_scaled(cls, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, bias: float = 0.0) -> Linear:
        return cls(tuple(map(float, w / scale)), float(bias - (w * mean / scale).sum()))

    def values(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.weights) + self.bias

    def column(self, features: Sequence[Column]) -> Column:
        total = F.lit(self.bias)
        for weight, feature in zip(self.weights, features, strict=True):
            total = total + F.lit(weight) * feature
        return total


def scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    return mean, np.where(scale > 1e-9, scale, 1.0)


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(value, F.lit(500.0)), F.lit(-500.0))))
