"""Bounded training samples, and linear models by follow-the-regularised-leader with elastic net."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows of each label, the same ones on every run: those whose ids hash lowest; rows: distinct.

    A bound on the hash, from each label's count, leaves few more than `most` to be ranked in one task.
    """
    counts = F.broadcast(rows.groupBy(label).agg(F.count("*").alias("_all")))  # one row a label
    place = F.xxhash64(F.col(key)).cast("double") / 2.0**64 + 0.5
    few = rows.join(counts, label).where(place * F.col("_all") <= most + 8 * most**0.5 + 8).drop("_all")
    order = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key)), key))
    return few.withColumn("_nth", order).where(F.col("_nth") <= most).drop("_nth")


class Ftrl:
    """FTRL-proximal, one weight vector for each class (softmax), or one in all (logistic) if classes is 1."""

    def __init__(self, dims: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, positive: bool = False):
        self.z, self.n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive

    def weights(self, at=slice(None)) -> np.ndarray:
        """Of some features; the last one is the bias, which no penalty holds back."""
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        if self.positive:  # features only add
            w[w < 0] = 0.0
        if isinstance(at, np.ndarray) and len(at) and at[-1] == len(self.z) - 1 or isinstance(at, slice):
            w[-1] = -z[-1] / ((self.beta + np.sqrt(n[-1])) / self.alpha)
        return w

    def step(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        at = np.r_[ids, len(self.z) - 1]
        x = np.r_[values, 1.0][:, None]
        w = self.weights(at)
        margin = (x * w).sum(0)
        if len(margin) == 1:
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label
        else:
            e = np.exp(margin - margin.max())
            error = e / e.sum()
            error[label] -= 1
        g = x * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.step(*rows[i])
        return self
