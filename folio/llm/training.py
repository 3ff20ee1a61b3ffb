"""Small helpers for models that are trained in numpy on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def bounded_sample(rows: DataFrame, by: str, each: int, key: str) -> DataFrame:
    """At most ``each`` rows per value of ``by``: those whose key's hash is smallest.

    Planned as a window group limit, so tasks hand on no more than that.
    """
    order = Window.partitionBy(by).orderBy(F.xxhash64(key), key)
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= each).drop("_place")


def draw(rows: int, most: int, seed: int | None) -> np.ndarray:
    """At most ``most`` of so many rows, spread over all of them by a seeded draw, in order."""
    if rows <= most:
        return np.arange(rows)
    return np.sort(np.random.default_rng(abs(seed or 0)).choice(rows, most, replace=False))


class Adam:
    """Gradient steps with first and second moments."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, first: dict | None = None, second: dict | None = None, steps: int = 0):
        self.weights, self.rate, self.steps = weights, rate, steps
        self.first = first or {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = second or {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        scale = self.rate * (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            self.weights[k] -= (scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(self.weights[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
