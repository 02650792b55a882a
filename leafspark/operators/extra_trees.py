"""Extremely random trees and a one-class learner, grown and fitted by passes over all rows.

Trees grow a level a pass: every node draws some factors and one random cut for each, the rows of all trees are counted
by node, candidate, side and class in the tasks, and the driver keeps the best candidate of each node. What leaves the tasks
depends on the trees and not on the rows. Draws come from a seeded generator, so a rerun gives the same trees.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.operators.many_models import shared_sums

at_place = lambda i: F.element_at("features", i + 1)


def draw(seed: int, level: int, low: np.ndarray, high: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """(factor, cut) [node, candidate] for nodes with these boxes [node, factor]: different factors, cuts within the box."""
    rng = np.random.default_rng([seed, level])
    factor = np.argsort(rng.random(low.shape), axis=1, kind="stable")[:, :candidates]
    rows = np.arange(len(low))[:, None]
    return factor, low[rows, factor] + rng.random(factor.shape) * (high[rows, factor] - low[rows, factor])


class Forest:
    """Trees as arrays [tree, node], nodes 1, 2 and 3, 4 to 7, ...; factor -1 marks a leaf."""

    def __init__(self, trees: int, depth: int):
        size = 2 ** (depth + 1)
        self.depth, self.factor, self.cut, self.share = depth, np.full((trees, size), -1), np.zeros((trees, size)), np.full((trees, size), 0.5)

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        tree, node = np.arange(len(self.factor)), np.ones((len(x), len(self.factor)), dtype=int)
        for _ in range(self.depth if depth is None else depth):
            factor = self.factor[tree, node]
            right = np.take_along_axis(x, np.maximum(factor, 0), axis=1) > self.cut[tree, node]
            node = np.where(factor < 0, node, 2 * node + right)
        return node

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.share[np.arange(len(self.factor)), self.leaves(x)].mean(1)


def _impurity(n, ones):
    return 2 * ones * (n - ones) / np.maximum(n, 1)


def grow(train: DataFrame, dims: int, trees: int = 100, depth: int = 8, candidates: int | None = None, seed: int = 42, least: int = 2) -> Forest:
    """A forest of all rows; ``candidates`` factors a node (by default the root of their number), nodes under ``least`` rows are leaves."""
    candidates = candidates or max(1, math.isqrt(dims))
    forest = Forest(trees, depth)
    row = train.agg(*[f(at_place(i)).alias(f"{n}{i}") for i in range(dims) for n, f in (("l", F.min), ("h", F.max))]).first()
    low, high = (np.tile([float(row[f"{n}{i}"] or 0.0) for i in range(dims)], (trees, 1)) for n in "lh")
    tree, node = np.arange(trees), np.ones(trees, dtype=int)  # the nodes of the level that may be split
    for level in range(depth + 1):
        place = np.full((trees, 2 ** (level + 1)), -1)
        place[tree, node] = np.arange(len(tree))
        factor, cut = draw(seed, level, low, high, candidates)

        def part(x, y, level=level, place=place, factor=factor, cut=cut):
            at = forest.leaves(x, level)
            at = place[np.arange(trees), np.where(at < place.shape[1], at, 0)]
            rows, own = np.nonzero(at >= 0)
            k = at[rows, own]
            right = x[rows[:, None], factor[k]] > cut[k]
            spot = ((k[:, None] * candidates + np.arange(candidates)) * 2 + right) * 2 + y[rows][:, None]
            return np.bincount(spot.ravel(), minlength=len(factor) * candidates * 4).astype(float)
        found = shared_sums(train, len(tree) * candidates * 4, part).reshape(len(tree), candidates, 2, 2)
        n, ones = found[:, 0].sum((1, 2)), found[:, 0, :, 1].sum(1)
        forest.share[tree, node] = np.where(n > 0, ones / np.maximum(n, 1), forest.share[tree, node // 2])
        if level == depth:
            break
        sides, side_ones = found.sum(3), found[..., 1]
        gain = _impurity(n, ones)[:, None] - _impurity(sides, side_ones).sum(2)
        gain = np.where((sides > 0).all(2), np.round(gain, 9), -1.0)
        best = gain.argmax(1)
        rows = np.arange(len(tree))
        good = (gain[rows, best] >= 0) & (n >= least) & (ones > 0) & (ones < n)
        forest.factor[tree[good], node[good]] = factor[rows, best][good]
        forest.cut[tree[good], node[good]] = cut[rows, best][good]
        if not good.any():
            break
        f, c = factor[rows, best][good], cut[rows, best][good]
        left_high, right_low = high[good].copy(), low[good].copy()
        left_high[np.arange(len(f)), f], right_low[np.arange(len(f)), f] = c, c
        low, high = np.concatenate((low[good], right_low)), np.concatenate((left_high, high[good]))
        tree, node = np.tile(tree[good], 2), np.concatenate((2 * node[good], 2 * node[good] + 1))
    return forest


def _scored(rows: DataFrame, score) -> DataFrame:
    @F.pandas_udf("double")
    def column(features: pd.Series) -> pd.Series:
        return pd.Series(score(np.array(features.tolist(), dtype=float))) if len(features) else pd.Series([], dtype=float)
    return rows.withColumn("score", column("features"))


class ExtraTrees:
    def __init__(self, dims: int, trees: int = 100, depth: int = 8, seed: int = 42):
        self.dims, self.trees, self.depth, self.seed = dims, trees, depth, seed

    def fit(self, train: DataFrame):
        forest = grow(train, self.dims, self.trees, self.depth, seed=self.seed)
        return lambda rows: _scored(rows, forest.scores).withColumn("prediction", (F.col("score") > 0.5).cast("int"))


class FourierOneClass:
    """Novelty against the crop rows: a one-class machine on random Fourier features of a Gaussian kernel.

    Minimises |w|^2 / 2 - rho + the mean of max(0, rho - w z) / nu by subgradient passes over the crop rows; rho is the
    nu quantile of w z over them, so the share ``nu`` of the crop lies outside. score rises from 0 to 1 with novelty.
    """

    def __init__(self, dims: int, nu: float = 0.99, size: int = 200, steps: int = 12, seed: int = 42):
        self.dims, self.nu, self.size, self.steps, self.seed = dims, nu, size, steps, seed

    def fit(self, train: DataFrame):
        crop = train.filter("type = 0")
        stats = crop.agg(*[f(at_place(i)).alias(f"{n}{i}") for i in range(self.dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
        mean, spread = (np.array([float(stats[f"{n}{i}"] or d) for i in range(self.dims)]) for n, d in (("m", 0.0), ("s", 1.0)))
        rng = np.random.default_rng(self.seed)
        omega, phase = rng.normal(size=(self.dims, self.size)) / math.sqrt(self.dims), rng.random(self.size) * 2 * math.pi
        z = lambda x: math.sqrt(2 / self.size) * np.cos((x - mean) / spread @ omega + phase)
        bins = 2048  # of scores between -2 and 2: |z|^2 is 2 at most and w is a mean of z
        w, rho = np.zeros(self.size), np.inf
        for step in range(self.steps):
            def part(x, y, w=w, rho=rho):
                own = z(x)
                score = own @ w
                return np.concatenate((own[score < rho].sum(0), np.bincount(np.clip((score + 2) / 4 * bins, 0, bins - 1).astype(int), minlength=bins)))
            sums = shared_sums(crop, self.size + bins, part)
            pull = sums[:self.size] / (self.nu * max(stats["n"], 1))
            w = w + (pull - w) * (1.0 if step == 0 else 1 / (step + 1))
            rho = -np.inf if not stats["n"] else np.inf if step == 0 else np.searchsorted(np.cumsum(sums[self.size:]), self.nu * stats["n"]) / bins * 4 - 2
        value = lambda x: z(x) @ w
        cut = _scored(crop, value).agg(F.percentile_approx("score", self.nu, 10_000)).first()[0]

        def score(rows: DataFrame) -> DataFrame:
            marked = _scored(rows, value).withColumn("prediction", (F.col("score") < F.lit(cut)).cast("int"))
            return marked.withColumn("score", (2 - F.col("score")) / 4)
        return score
