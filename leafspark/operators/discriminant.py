"""Linear discriminant from class sums.

Two passes over the table give the mean and, about it, counts, sums and cross products per class (large means cancel
nothing). The driver solves a system of the
size of the factor list, and rows are scored by a Column. Any subset of factors can be solved from the same sums,
so a sweep over factor combinations reads the training rows once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ClassSums:
    """Counts, means and the pooled covariance of two classes."""

    def __init__(self, train: DataFrame, dims: int):
        center = train.agg(F.array(*[F.avg(F.element_at("features", i + 1)) for i in range(dims)])).first()[0]
        if center is None or None in center:
            raise ValueError("training rows of both classes are needed")
        center = np.array(center)

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, dims + 1, dims + 1))
            for frame in batches:
                x = np.array(frame.features.tolist(), dtype=float).reshape(len(frame), -1)[:, :dims] - center
                x = np.concatenate((np.ones((len(x), 1)), x), 1)
                for t in (0, 1):
                    rows = x[frame.type.to_numpy() == t]
                    total[t] += rows.T @ rows
            yield pd.DataFrame({"type": [0, 1], "m": list(total.reshape(2, -1))})
        # Each task leaves one matrix a class; they are added by place, so the driver gets two matrices.
        parts = train.select("features", "type").mapInPandas(gather, "type int, m array<double>").select("type", F.posexplode("m").alias("at", "v"))
        total = np.zeros((2, (dims + 1) ** 2))
        for r in parts.groupBy("type", "at").agg(F.sum("v").alias("v")).collect():
            total[r["type"], r["at"]] = r["v"]
        total = total.reshape(2, dims + 1, dims + 1)
        self.n = [int(round(total[t, 0, 0])) for t in (0, 1)]
        if not all(self.n):
            raise ValueError("training rows of both classes are needed")
        own = [total[t, 0, 1:] / self.n[t] for t in (0, 1)]
        self.means = [m + center for m in own]
        pooled = sum(total[t, 1:, 1:] - self.n[t] * np.outer(own[t], own[t]) for t in (0, 1))
        self.covariance = pooled / (sum(self.n) - 2)

    def solve(self, picked: Sequence[int] | None = None) -> tuple[np.ndarray, float]:
        """(weights, offset) on all factors or on some positions."""
        at = np.arange(len(self.means[0])) if picked is None else np.asarray(picked)
        inverse = np.linalg.pinv(self.covariance[np.ix_(at, at)])
        m0, m1 = self.means[0][at], self.means[1][at]
        weights = inverse @ (m1 - m0)
        offset = -0.5 * (m1 @ inverse @ m1 - m0 @ inverse @ m0) + math.log(self.n[1] / self.n[0])
        return weights, float(offset)


def score_column(weights: Sequence[float], offset: float, positions: Sequence[int] | None = None) -> Column:
    """Probability of class 1."""
    at = range(len(weights)) if positions is None else positions
    raw = F.lit(float(offset))
    for w, i in zip(weights, at):
        raw = raw + F.element_at("features", int(i) + 1) * float(w)
    return 1 / (1 + F.exp(-raw))


def fit_score(train: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """rows with ``score`` and ``prediction``."""
    weights, offset = ClassSums(train, dims).solve()
    return rows.withColumn("score", score_column(weights, offset)).withColumn("prediction", (F.col("score") > 0.5).cast("int"))
