"""Many small models at once: one technique fitted on every combination of factors by shared passes over the rows.

A pass reads the training rows once and adds up, in every task, what all combinations need for their next step: second
order sums for the linear techniques, histograms of a tree level for trees, leaf counts for random trees. Only these sums
leave the tasks; their number depends on the combinations and not on the rows. The number of passes is that of the steps
of one model, whatever the number of combinations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.operators.discriminant import ClassSums

#: Rows that a task works on at once (combinations x factors x rows numbers are held).
ROWS = 128
#: Trees that a block of rows goes down at once.
TREES_AT_ONCE = 500
#: Combinations whose counts leave a task in one frame.
COMBOS_OUT = 100
STEPS, DEPTH, BINS, TREES = 12, 4, 16, 10
#: Penalties of the weights, as 1 / C.
PENALTY = {"LOGISTIC": 0.01, "SVM": 1.0}


def _blocks(batches):
    for frame in batches:
        for start in range(0, len(frame), ROWS):
            part = frame.iloc[start:start + ROWS]
            yield np.array(part["features"].tolist(), dtype=float), part["type"].to_numpy(dtype=int)


def shared_sums(rows: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(x, y), ``size`` numbers, over blocks of all rows; added in the tasks, then by place."""
    def run(batches):
        total = np.zeros(size)
        for x, y in _blocks(batches):
            total += part(x, y)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "v": total[at]})
    found = rows.select("features", "type").mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # size numbers at most
    out = np.zeros(size)
    out[found["at"].to_numpy(dtype=int)] = found["v"].to_numpy()
    return out


@dataclass
class Linear:
    """weights[combination, factor] and offsets; class 1 from one half on."""
    combos: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.einsum("nck,ck->nc", x[:, self.combos], self.weights) + self.offsets
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


@dataclass
class Trees:
    """Per combination some trees of one depth, nodes numbered 1, 2 and 3, 4 to 7, ...: the factor's place in the
    combination (-1: a leaf early on), the cut (larger values go right) and the share of class 1 of every node."""
    combos: np.ndarray
    factor: np.ndarray
    cut: np.ndarray
    share: np.ndarray

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """[row, combination, tree]: the node after so many steps; some trees at a time, so that what is looked up stays near."""
        many, trees, size = self.factor.shape
        nodes = np.empty((len(x), many * trees), dtype=int)
        column = np.where(self.factor < 0, -1, np.take_along_axis(self.combos[:, None], np.maximum(self.factor, 0), 2)).ravel()
        cut, values, row = self.cut.ravel(), np.ascontiguousarray(x).ravel(), np.arange(len(x))[:, None] * x.shape[1]
        early = bool((self.factor[:, :, 1:2 ** depth] < 0).any())
        for first in range(0, many * trees, TREES_AT_ONCE):
            start = np.arange(first, min(first + TREES_AT_ONCE, many * trees)) * size
            node = np.ones((len(x), len(start)), dtype=int)
            for _ in range(depth):
                at = start + node
                factor = column.take(at)
                below = 2 * node + (values.take(row + factor, mode="wrap") > cut.take(at))
                node = np.where(factor < 0, node, below) if early else below
            nodes[:, first:first + len(start)] = node
        return nodes.reshape(len(x), many, trees)

    def scores(self, x: np.ndarray) -> np.ndarray:
        many, trees, size = self.share.shape
        leaf = self.leaves(x, (size // 2).bit_length() - 1)
        leaf += np.arange(many * trees).reshape(many, trees) * size
        return self.share.ravel().take(leaf).mean(2)


def discriminants(train: DataFrame, combos: np.ndarray, dims: int) -> Linear:
    sums = ClassSums(train, dims)
    solved = [sums.solve(at) for at in combos]
    return Linear(combos, np.array([w for w, _ in solved]), np.array([o for _, o in solved]))


def newton(train: DataFrame, combos: np.ndarray, name: str, steps: int = STEPS) -> Linear:
    """Logistic regression or squared-hinge support vectors by Newton's method, all combinations in the same passes."""
    many, k = combos.shape
    w = np.zeros((many, k + 1))
    penalty = np.append(np.full(k, PENALTY[name]), 0.0)

    for _ in range(steps):
        def part(x, y, w=w):
            z = np.concatenate((x[:, combos], np.ones((len(x), many, 1))), 2)
            margin = np.einsum("nck,ck->nc", z, w)
            if name == "LOGISTIC":
                p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                curve, slope = p * (1 - p), y[:, None] - p
            else:
                sign = 2.0 * y[:, None] - 1
                curve = (sign * margin < 1).astype(float)
                slope = curve * (sign - margin)
            return np.concatenate((np.einsum("nc,nck->ck", slope, z).ravel(), np.einsum("nc,nck,ncl->ckl", curve, z, z).ravel()))
        sums = shared_sums(train, many * (k + 1) * (k + 2), part)
        slope = sums[:many * (k + 1)].reshape(many, k + 1) - penalty * w
        bend = sums[many * (k + 1):].reshape(many, k + 1, k + 1) + np.eye(k + 1) * (penalty + 1e-9)
        step = np.linalg.solve(bend, slope[..., None])[..., 0]
        w = w + step
        if np.abs(step).max() < 1e-8 * (1 + np.abs(w).max()):
            break
    return Linear(combos, w[:, :k], w[:, k])


def factor_cuts(train: DataFrame, dims: int, bins: int = BINS) -> np.ndarray:
    """[factor, cut]: cuts at even shares of the training rows, approximate quantiles of bounded size."""
    at = [F.percentile_approx(F.element_at("features", i + 1), [b / bins for b in range(1, bins)], 10_000).alias(f"q{i}") for i in range(dims)]
    row = train.agg(*at).first()
    return np.array([row[f"q{i}"] for i in range(dims)], dtype=float)


def _gini(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Size times impurity."""
    return 2 * ones * (n - ones) / np.maximum(n, 1e-300)


def grown_trees(train: DataFrame, combos: np.ndarray, dims: int, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """One decision tree a combination, a level a pass: histograms of the nodes' rows by bin and class, best Gini gain."""
    many, k = combos.shape
    of_factor = factor_cuts(train, dims, bins)
    cuts = of_factor[combos]
    trees = Trees(combos, np.full((many, 1, 2 ** (depth + 1)), -1), np.zeros((many, 1, 2 ** (depth + 1))), np.zeros((many, 1, 2 ** (depth + 1))))
    for level in range(depth + 1):
        width = 2 ** level

        def part(x, y, level=level, width=width):
            node = trees.leaves(x, level)[:, :, 0] - width
            bin_of = (x[..., None] > of_factor).sum(2)[:, combos]
            spot = ((np.arange(many)[:, None] * width + node[..., None]) * k + np.arange(k)) * bins + bin_of
            live = np.broadcast_to(node[..., None] >= 0, spot.shape)
            spot = spot * 2 + y[:, None, None]
            return np.bincount(spot[live], minlength=many * width * k * bins * 2).astype(float)
        found = shared_sums(train, many * width * k * bins * 2, part).reshape(many, width, k, bins, 2)
        n, ones = found.sum((3, 4))[:, :, 0], found[..., 1].sum(3)[:, :, 0]
        own = slice(width, 2 * width)
        above = np.repeat(trees.share[:, 0, width // 2:width], 2, axis=1) if level else np.full((many, 1), 0.5)
        trees.share[:, 0, own] = np.where(n > 0, ones / np.maximum(n, 1), above)
        if level == depth:
            break
        left = found.cumsum(3)[:, :, :, :-1]
        left_n, left_ones = left.sum(4), left[..., 1]
        total_n, total_ones = n[:, :, None, None], ones[:, :, None, None]
        gain = _gini(total_n, total_ones) - _gini(left_n, left_ones) - _gini(total_n - left_n, total_ones - left_ones)
        gain = np.where((left_n > 0) & (left_n < total_n), np.round(gain, 9), -1.0).reshape(many, width, -1)
        best = gain.argmax(2)
        factor, at = best // (bins - 1), best % (bins - 1)
        good = np.take_along_axis(gain, best[..., None], 2)[..., 0] > 1e-9
        trees.factor[:, 0, own] = np.where(good, factor, -1)
        trees.cut[:, 0, own] = cuts[np.arange(many)[:, None], factor, at]
    # A node without rows passes its share on; leaves above the last level keep theirs.
    return trees


def random_trees(train: DataFrame, combos: np.ndarray, dims: int, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> Trees:
    """Extremely random trees on few factors: with one candidate factor a node (the root of two or three), factor and cut are
    drawn before any row is seen, the cut from what the cuts above leave of the factor's range. One pass counts the leaves."""
    many, k = combos.shape
    at = lambda i: F.element_at("features", i + 1)
    row = train.agg(*[f(at(i)).alias(f"{n}{i}") for i in range(dims) for n, f in (("l", F.min), ("h", F.max))]).first()
    low, high = (np.array([float(row[f"{n}{i}"] or 0) for i in range(dims)])[combos] for n in "lh")
    rng = np.random.default_rng(seed)
    size = 2 ** (depth + 1)
    out = Trees(combos, np.full((many, trees, size), -1), np.zeros((many, trees, size)), np.full((many, trees, size), 0.5))
    box = {1: (np.repeat(low[:, None], trees, 1), np.repeat(high[:, None], trees, 1))}
    c, t = np.ogrid[:many, :trees]
    for node in range(1, size // 2):
        floor, top = box.pop(node)
        factor = rng.integers(0, k, (many, trees))
        cut = floor[c, t, factor] + rng.random((many, trees)) * (top[c, t, factor] - floor[c, t, factor])
        out.factor[:, :, node], out.cut[:, :, node] = factor, cut
        below, over = top.copy(), floor.copy()
        below[c, t, factor], over[c, t, factor] = cut, cut
        box[2 * node], box[2 * node + 1] = (floor, below), (over, top)

    def part(x, y):
        spot = out.leaves(x, depth)
        spot += (c * trees + t) * (size // 2) - size // 2
        spot *= 2
        spot += y[:, None, None]
        return np.bincount(spot.ravel(), minlength=many * trees * size).astype(float)
    found = shared_sums(train, many * trees * size, part).reshape(many, trees, size // 2, 2)
    n = found.sum(3)
    out.share[:, :, size // 2:] = np.where(n > 0, found[..., 1] / np.maximum(n, 1), 0.5)
    return out


def fit_many(train: DataFrame, combos: Sequence[Sequence[int]], dims: int, name: str):
    """The models of one technique on all combinations (all of one length): LDA, LOGISTIC, SVM, DECISIONTREE or EXTRA."""
    at = np.array(combos, dtype=int).reshape(len(combos), -1)
    makers = {"LDA": lambda: discriminants(train, at, dims), "LOGISTIC": lambda: newton(train, at, "LOGISTIC"), "SVM": lambda: newton(train, at, "SVM"),
              "DECISIONTREE": lambda: grown_trees(train, at, dims), "EXTRA": lambda: random_trees(train, at, dims)}
    if name not in makers:
        raise ValueError(f"unknown technique {name!r}; known: {sorted(makers)}")
    return makers[name]()


def counted(total: np.ndarray, start: int = 0):
    """Frames of the counts that are not zero, some combinations at a time. total: [actual, combination, place]."""
    for first in range(0, total.shape[1], COMBOS_OUT):
        part = total[:, first:first + COMBOS_OUT]
        kind, combo, place = np.nonzero(part)
        yield pd.DataFrame({"id": combo + first + start, "place": place, "actual": kind, "n": part[kind, combo, place]})


def score_counts(test: DataFrame, model, bins: int) -> DataFrame:
    """id (place of the combination), place (of the score in so many bins), actual, n: counts of the test rows."""
    many = len(model.combos)

    def run(batches):
        total = np.zeros(2 * many * bins, dtype=np.int64)
        for x, y in _blocks(batches):
            place = np.minimum((model.scores(x) * bins).astype(int), bins - 1)
            total += np.bincount(((y[:, None] * many + np.arange(many)) * bins + place).ravel(), minlength=len(total))
        yield from counted(total.reshape(2, many, bins))
    return test.select("features", "type").mapInPandas(run, "id bigint, place int, actual int, n bigint")
