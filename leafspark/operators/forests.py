"""Random forests grown by passes over binned rows, for tables on which the trees of Spark ML take too long or fill the driver.

The trees are those of Spark ML: Poisson bags, at most 32 bins a factor, some random factors a node, the split with the
largest Gini gain, children with the same prediction merged. Rows are written once as blocks of bytes. A level is one pass: a
task counts its rows tree after tree, the counts of a tree meet in one group, and only the chosen splits reach the driver,
where a node takes a few bytes. Bags and factors are drawn from the numbers of block, tree and level, so a rerun gives the
same trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.session import cut_lineage

BINS = 32
#: Rows of a block, and of the blocks that a task holds: a byte each for the class and for every factor.
BLOCK, ROWS_OF_TASK = 16_384, 1 << 19
#: Rows times trees up to which Spark ML grows a forest, whose nodes are objects on the driver.
OBJECTS = 1_024_000
LEAF, OPEN = -1, -2
#: Weights in a bag by 16 random bits: a Poisson distribution with mean 1.
BAG = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def few(rows: int, trees: int) -> bool:
    return rows * trees <= OBJECTS


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)
    if np.isnan(x).any():
        raise ValueError("factors must not be null or NaN")
    return x


def _edges(df: DataFrame, dims: int) -> list[np.ndarray]:
    """The cuts of every factor: between all values if these are few, else quantiles of all rows."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = [np.zeros(0)] * dims
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                for i in range(dims):
                    if seen[i] is not None:
                        found = np.union1d(seen[i], x[:, i])
                        seen[i] = found if len(found) <= BINS else None
        kept = [(i, v) for i, s in enumerate(seen) for v in ([None] if s is None else s.tolist())]
        yield pa.RecordBatch.from_pydict({"factor": pa.array([i for i, _ in kept], pa.int32()), "value": pa.array([v for _, v in kept], pa.float64())})
    listed = df.select("features").mapInArrow(values, "factor int, value double").groupBy("factor").agg(
        F.bool_or(F.col("value").isNull()).alias("many"), F.collect_set("value").alias("values"))
    short = {r["factor"]: np.sort(r["values"]) for r in listed.filter(f"not many and size(values) <= {BINS}").collect()}
    steps = [i / BINS for i in range(1, BINS)]
    long = [i for i in range(dims) if i not in short]
    row = df.agg(F.lit(0), *[F.percentile_approx(F.element_at("features", i + 1), steps, 10_000).alias(f"q{i}") for i in long]).first()
    return [(short[i][1:] + short[i][:-1]) / 2 if i in short else np.unique(row[f"q{i}"]) for i in range(dims)]


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value: values up to a cut go left."""
    out = np.empty(x.shape, np.uint8)
    for i, cuts in enumerate(edges):
        out[:, i] = np.searchsorted(cuts, x[:, i], side="left")
    return out


class Binned:
    """A table (features, type) as blocks of rows: the bins of the factors and the class, a byte each."""

    def __init__(self, df: DataFrame):
        facts = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("dims"), F.max("type").alias("top")).first()
        self.rows, self.dims, self.classes = facts["n"], facts["dims"], max(2, facts["top"] + 1)
        self.edges = edges = _edges(df, self.dims)

        def pack(batches):
            part, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
            for batch in batches:
                if len(batch):
                    held.append((_binned(_matrix(batch.column(0)), edges), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)))
                    size += len(batch)
                if size >= BLOCK:
                    yield block(part + number, held)
                    number, held, size = number + 1, [], 0
            if held:
                yield block(part + number, held)

        def block(number, held):
            x, y = (np.concatenate(v) for v in zip(*held))
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-self.rows // ROWS_OF_TASK))
        self.table = cut_lineage(df.select("features", "type").coalesce(parts).mapInArrow(pack, "block long, x binary, y binary"))


class Forest:
    """Trees as arrays [tree, node], nodes 1, 2 and 3, 4 to 7, ...: the factor of a split (negative: none), the last bin that
    goes left, the split's gain times its rows, and the rows of each class."""

    def __init__(self, trees: int, depth: int, classes: int):
        size = 2 ** (depth + 1)
        self.depth, self.factor, self.cut = depth, np.full((trees, size), LEAF, np.int16), np.zeros((trees, size), np.uint8)
        self.gain, self.counts = np.zeros((trees, size // 2), np.float32), np.zeros((trees, size, classes), np.uint32)

    def prune(self) -> None:
        """Children that are leaves with the same prediction are merged, from below."""
        for level in range(self.depth - 1, -1, -1):
            up, down = slice(1 << level, 2 << level), slice(2 << level, 4 << level)
            leaf, said = self.factor[:, down] < 0, self.counts[:, down].argmax(2)
            self.factor[:, up][leaf[:, ::2] & leaf[:, 1::2] & (said[:, ::2] == said[:, 1::2])] = LEAF

    def importances(self, keep: Sequence[int]) -> np.ndarray:
        """Shares of the gain, the same weight for each tree that has a split."""
        total = np.zeros(len(keep))
        place = {f: i for i, f in enumerate(keep)}
        for factor, gain in zip(self.factor[:, :self.gain.shape[1]], self.gain):
            at = np.flatnonzero(factor >= 0)
            if len(at):
                total += np.bincount([place[f] for f in factor[at].tolist()], gain[at], len(keep)) / gain[at].sum(dtype=float)
        return total / max(total.sum(), 1e-300)

    def shares(self) -> np.ndarray:
        return self.counts / np.maximum(self.counts.sum(2, keepdims=True), 1)


def _drawn(seed: int, tree: int, level: int, nodes: int, keep: np.ndarray, many: int) -> np.ndarray:
    """[node, candidate]: the factors that the nodes of a level may use."""
    rng = np.random.default_rng([seed, tree, level])
    if many >= len(keep):
        return np.tile(keep, (nodes, 1))
    return keep[rng.integers(0, len(keep), (nodes, 1))] if many == 1 else keep[np.argpartition(rng.random((nodes, len(keep))), many, axis=1)[:, :many]]


def _bag(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    return BAG[np.frombuffer(np.random.default_rng([seed, tree, block, 1]).bytes(2 * rows), np.uint16)]


def _best(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The candidate, bin, gain times rows and left and right classes of the best split of each node; the gain is 0 if no
    split gains. counts: [node, candidate, bin, class]."""
    left = counts.cumsum(2)
    right = left[:, :, -1:] - left

    def impurity(c):
        n = c.sum(3)
        return n - (c * c).sum(3) / np.maximum(n, 1)
    whole = impurity(left[:, :, -1:])
    gain = np.where((left.sum(3) > 0) & (right.sum(3) > 0), whole - impurity(left) - impurity(right), 0).reshape(len(counts), -1)
    at, rows = gain.argmax(1), np.arange(len(counts))
    own, cut = at // counts.shape[2], at % counts.shape[2]
    found = gain[rows, at]
    found = np.where(found > 1e-9 * left[:, 0, -1].sum(1), found, 0)
    some = (found > 0)[:, None]
    return own, cut, found, np.where(some, left[rows, own, cut], left[:, 0, -1]), np.where(some, right[rows, own, cut], 0)


def grow(data: Binned, keep: Sequence[int], trees: int, depth: int, candidates: int, seed: int) -> Forest:
    """A forest on the factors ``keep``, of which every node draws ``candidates``."""
    forest, dims, classes, factors = Forest(trees, depth, data.classes), data.dims, data.classes, np.array(keep)
    many = min(candidates, len(factors))
    forest.factor[:, 1] = OPEN
    for level in range(depth):
        first = 1 << level
        if not (forest.factor[:, first:2 * first] == OPEN).any():
            break
        factor, cut = forest.factor[:, :2 * first].copy(), forest.cut[:, :first].copy()

        def count(batches, level=level, first=first, factor=factor, cut=cut):
            blocks = [(int(r.block), np.frombuffer(r.x, np.uint8), np.frombuffer(r.y, np.uint8)) for frame in batches for r in frame.itertuples(index=False)]
            for tree in range(trees):
                open_ = np.flatnonzero(factor[tree, first:] == OPEN)
                if not len(open_):
                    continue
                place = np.full(first, -1)
                place[open_] = np.arange(len(open_))
                columns = np.ascontiguousarray(_drawn(seed, tree, level, len(open_), factors, many).T)
                size = len(open_) * BINS * classes
                total = np.zeros((many, size))
                for block, x, y in blocks:
                    weight = _bag(seed, tree, block, len(y))
                    rows = np.flatnonzero(weight)
                    base, node = rows * dims, np.ones(len(rows), np.intp)
                    for _ in range(level):
                        split = factor[tree].take(node)
                        on = split >= 0
                        if not on.all():
                            rows, base, node, split = rows[on], base[on], node[on], split[on]
                        right = x.take(base + split) > cut[tree].take(node)
                        node += node
                        node += right
                    at = place.take(node - first)
                    on = at >= 0
                    rows, base, at = rows[on], base[on], at[on]
                    own, weight = at * (BINS * classes) + y[rows], weight[rows].astype(float)
                    for k in range(many):
                        spot = x.take(base + columns[k].take(at)).astype(np.intp)
                        spot *= classes
                        spot += own
                        total[k] += np.bincount(spot, weight, size)
                yield pd.DataFrame({"tree": [tree], "counts": [total.astype(np.uint32).tobytes()]})

        def choose(frame):
            tree = int(frame["tree"].iloc[0])
            counts = sum(np.frombuffer(c, np.uint32).astype(float) for c in frame["counts"]).reshape(many, -1, BINS, classes).swapaxes(0, 1)
            own, last, gain, left, right = _best(counts)
            columns = _drawn(seed, tree, level, len(counts), factors, many)[np.arange(len(counts)), own]
            packed = (np.where(gain > 0, columns, LEAF).astype(np.int16), last.astype(np.uint8), gain.astype(np.float32), left.astype(np.uint32), right.astype(np.uint32))
            return pd.DataFrame({"tree": [tree], **{n: [v.tobytes()] for n, v in zip("abcde", packed)}})
        counted = data.table.mapInPandas(count, "tree int, counts binary").groupBy("tree")
        for r in counted.applyInPandas(choose, "tree int, a binary, b binary, c binary, d binary, e binary").collect():  # 23 bytes a node of the level
            tree, nodes = r["tree"], first + np.flatnonzero(factor[r["tree"], first:] == OPEN)
            split, last, gain = (np.frombuffer(r[n], kind) for n, kind in (("a", np.int16), ("b", np.uint8), ("c", np.float32)))
            left, right = (np.frombuffer(r[n], np.uint32).reshape(-1, classes) for n in "de")
            forest.factor[tree, nodes], forest.cut[tree, nodes], forest.gain[tree, nodes], forest.counts[tree, nodes] = split, last, gain, left + right
            some = split >= 0
            for child, counts in ((2 * nodes[some], left[some]), (2 * nodes[some] + 1, right[some])):
                forest.counts[tree, child] = counts
                forest.factor[tree, child] = np.where((level + 1 < depth) & (counts.max(1) < counts.sum(1)), OPEN, LEAF)
    forest.factor[forest.factor == OPEN] = LEAF
    forest.prune()
    return forest


def importances(data: Binned, keep: Sequence[int], trees: int, depth: int = 8, seed: int = 42) -> np.ndarray:
    """The importance of the factors ``keep``; every node draws the root of their number."""
    return grow(data, keep, trees, depth, math.ceil(math.sqrt(len(keep))) if trees > 1 else len(keep), seed).importances(keep)


def scores(forest: Forest, x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """[row, class]: the mean share of the rows' leaves. x: bins [row, factor]."""
    out, flat, base = np.zeros((len(x), share.shape[2])), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for factor, cut, own in zip(forest.factor, forest.cut, share):
        node = np.ones(len(x), np.intp)
        for _ in range(forest.depth):
            split = factor[node]
            on = split >= 0
            if not on.any():
                break
            node = np.where(on, 2 * node + (flat[base + np.maximum(split, 0)] > cut[node]), node)
        out += own[node]
    return out / len(forest.factor)


class RandomTrees:
    """A technique: ``candidates`` random factors a node."""

    def __init__(self, trees: int, depth: int, candidates: int, seed: int):
        self.trees, self.depth, self.candidates, self.seed = trees, depth, candidates, seed

    def fit(self, train: DataFrame):
        data = Binned(train)
        forest = grow(data, range(data.dims), self.trees, self.depth, self.candidates, self.seed)
        share, edges, kind = forest.shares().astype(np.float32), data.edges, "struct<score double, prediction int>"
        forest.counts = forest.gain = None

        @F.pandas_udf(kind)
        def found(features: pd.Series) -> pd.DataFrame:
            parts = [np.zeros((0, share.shape[2]))]
            for low in range(0, len(features), BLOCK // 4):
                x = np.stack(features.iloc[low:low + BLOCK // 4].to_numpy()).astype(float)
                parts.append(scores(forest, _binned(x, edges), share))
            chance = np.concatenate(parts)
            return pd.DataFrame({"score": chance[:, 1], "prediction": chance.argmax(1).astype(np.int32)})
        return lambda rows: rows.drop("score", "prediction").withColumn("_f", found("features")).select(
            *[c for c in rows.columns if c not in ("score", "prediction")], "_f.score", "_f.prediction")
