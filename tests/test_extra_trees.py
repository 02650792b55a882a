"""Random-cut trees level by level against a plain recount; the one-class share outside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.operators import extra_trees, forests, models, selection


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(600)], "id long, features array<double>, type int").repartition(4).cache()
    return df, x, y


def plain_grow(x, y, trees, depth, candidates, seed):
    """The same forest, one node after the other: {(tree, node): (factor, cut)} and leaf shares by row."""
    gini = lambda v: 2 * v.sum() * (len(v) - v.sum()) / max(len(v), 1)
    splits, share = {}, {}
    now = [(t, 1, np.ones(len(x), bool), x.min(0), x.max(0)) for t in range(trees)]
    for level in range(depth + 1):
        factor, cut = extra_trees.draw(seed, level, np.array([n[3] for n in now]), np.array([n[4] for n in now]), candidates)
        good, left, right = [], [], []
        for k, (t, node, rows, low, high) in enumerate(now):
            share[t, node] = y[rows].mean() if rows.any() else share[t, node // 2]
            best = (-1.0, None)
            for f, c in zip(factor[k], cut[k]):
                side = x[:, f] > c
                if (rows & side).any() and (rows & ~side).any():
                    gain = round(gini(y[rows]) - gini(y[rows & side]) - gini(y[rows & ~side]), 9)
                    if gain > best[0]:
                        best = (gain, (f, c))
            if level < depth and best[0] >= 0 and rows.sum() >= 2 and 0 < y[rows].sum() < rows.sum():
                f, c = splits[t, node] = best[1]
                top, floor = high.copy(), low.copy()
                top[f], floor[f] = c, c
                left.append((t, 2 * node, rows & (x[:, f] <= c), low, top))
                right.append((t, 2 * node + 1, rows & (x[:, f] > c), floor, high))
        now = left + right
        if not now:
            break
    return splits, share


def test_forest_equals_a_plain_one(table):
    df, x, y = table
    forest = extra_trees.grow(df, 5, trees=4, depth=4, candidates=2, seed=7)
    splits, share = plain_grow(x, y, 4, 4, 2, 7)
    got = {(t, n): (forest.factor[t, n], forest.cut[t, n]) for t, n in zip(*np.nonzero(forest.factor >= 0))}
    assert got == splits
    assert all(forest.share[k] == pytest.approx(v) for k, v in share.items())


def test_extra_trees_learn(table):
    df = table[0].withColumn("type", F.expr("int(features[0] + 0.5 * features[1] > 0)"))
    scorer = models.technique("EXTRA", 5).fit(df.filter("id < 400"))
    rows = scorer(df.filter("id >= 400")).collect()
    assert np.mean([r["prediction"] == r["type"] for r in rows]) > 0.8
    again = models.technique("EXTRA", 5).fit(df.filter("id < 400").repartition(7))(df.filter("id >= 400")).collect()
    assert {r["id"]: r["score"] for r in rows} == {r["id"]: r["score"] for r in again}
    assert len(models.technique("EXTRA", 5).fit(df.filter("type = 1"))(df.limit(3)).collect()) == 3


@pytest.mark.parametrize("nu", [0.1, 0.5, 0.99])
def test_share_outside_is_nu(spark, nu):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=3)], 0) for i in range(1500)] + [(5000 + i, [float(v) for v in rng.normal(6, 1, size=3)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, features array<double>, type int").repartition(4).cache()
    got = extra_trees.FourierOneClass(3, nu).fit(df)(df).collect()
    outside = np.mean([r["prediction"] for r in got if r["type"] == 0])
    assert abs(outside - nu) < 0.02
    assert np.mean([r["prediction"] for r in got if r["type"] == 1]) > 0.95
    assert np.mean([r["score"] for r in got if r["type"] == 1]) > np.mean([r["score"] for r in got if r["type"] == 0])


def plain_forest(x, y, block, edges, keep, trees, depth, candidates, seed):
    """The forest of :mod:`forests`, one node after the other: {(tree, node): (factor, cut)} after merging, and the class counts of all nodes."""
    bins = np.stack([(x[:, i][:, None] > edges[i]).sum(1) for i in range(x.shape[1])], axis=1)
    splits, counts = {}, {}
    for t in range(trees):
        weight = np.zeros(len(x))
        for b in np.unique(block):
            weight[block == b] = forests._bag(seed, t, int(b), int((block == b).sum()))
        classes = lambda rows, w=weight: np.bincount(y[rows], w[rows], 2)
        impure = lambda c: c.sum() - (c * c).sum() / max(c.sum(), 1)
        now = [(1, np.ones(len(x), bool))]
        for level in range(depth):
            after, drawn = [], forests._drawn(seed, t, level, len(now), np.array(keep), candidates)
            for k, (node, rows) in enumerate(now):
                whole, best = classes(rows), (0, None)
                counts[t, node] = whole
                for f in drawn[k]:
                    for cut in range(forests.BINS):
                        left, right = classes(rows & (bins[:, f] <= cut)), classes(rows & (bins[:, f] > cut))
                        gain = impure(whole) - impure(left) - impure(right)
                        if left.sum() and right.sum() and gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
                if best[1]:
                    f, cut = splits[t, node] = best[1]
                    for child, own in ((2 * node, rows & (bins[:, f] <= cut)), (2 * node + 1, rows & (bins[:, f] > cut))):
                        counts[t, child] = classes(own)
                        if counts[t, child].min() > 0:
                            after.append((child, own))
            now = sorted(after, key=lambda a: a[0])
        for node in sorted((n for s, n in splits if s == t), reverse=True):
            if not {(t, 2 * node), (t, 2 * node + 1)} & set(splits) and counts[t, 2 * node].argmax() == counts[t, 2 * node + 1].argmax():
                del splits[t, node]
    return splits, counts


def test_binned_forest_equals_a_plain_one(spark, table, monkeypatch):
    df, x, y = table
    monkeypatch.setattr(forests, "BLOCK", 90)
    data = forests.Binned(df.withColumn("features", F.concat("features", F.array((F.col("id") % 3).cast("double")))))
    assert data.edges[5].tolist() == [0.5, 1.5] and [len(e) for e in data.edges[:5]] == [31] * 5
    blocks = data.table.toPandas()
    bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, 6) for b in blocks.x])
    classes = np.concatenate([np.frombuffer(b, np.uint8) for b in blocks.y])
    number = np.repeat(blocks.block, [len(b) for b in blocks.y]).to_numpy()
    assert len(classes) == 600 and sorted(classes) == sorted(y) and len(set(number)) >= 4
    # The bins stand for the values: their own numbers, cut between them.
    edges = [np.arange(forests.BINS) + 0.5] * 6
    keep = [0, 1, 3, 5]
    splits, counts = plain_forest(bins, classes, number, edges, keep, 3, 4, 2, 7)
    forest = forests.grow(data, keep, 3, 4, 2, 7)
    for t, node in zip(*np.nonzero(forest.factor >= 0)):
        assert splits.pop((t, node)) == (forest.factor[t, node], forest.cut[t, node])
    assert not splits
    for (t, node), c in counts.items():
        assert forest.counts[t, node].tolist() == c.tolist()


def test_large_tables_get_the_binned_forest(spark, table, monkeypatch):
    """No node of a large forest is an object of Spark ML on the driver; few rows keep the forest that they had."""
    df, x, y = table
    train, test = df.filter("id < 400"), df.filter("id >= 400")
    ranks = lambda: {r["factor"]: r["score"] for r in selection.recursive(df, list("abcde"), trees=20).collect()}
    old, score = ranks(), lambda: {r["id"]: r for r in models.technique("RANDOMFOREST", 5, trees=60).fit(train)(test).collect()}
    few = score()
    monkeypatch.setattr(forests, "OBJECTS", 0)
    for name in ("models", "selection"):
        monkeypatch.setattr(globals()[name], "RandomForestClassifier", None)
    new, many = ranks(), score()
    assert {f for f, r in old.items() if r < 3} == {f for f, r in new.items() if r < 3} == {"a", "b"} and sorted(new.values()) == [1, 2, 3, 4, 5]
    assert many == score() and set(many) == set(few) and list(many[400].asDict()) == list(few[400].asDict())
    right = lambda found: np.mean([r["prediction"] == r["type"] for r in found.values()])
    assert abs(right(many) - right(few)) < 0.06 and all(r["prediction"] == int(r["score"] > 0.5) for r in many.values())
    assert np.corrcoef([few[i]["score"] for i in few], [many[i]["score"] for i in few])[0, 1] > 0.8
    with pytest.raises(Exception, match="null or NaN"):
        forests.Binned(df.withColumn("features", F.array(F.lit(None).cast("double"), F.lit(1.0)))).table.count()
