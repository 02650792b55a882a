"""Models of all combinations from shared passes against one model at a time."""

from itertools import combinations

import numpy as np
import pytest

from leafspark.operators import many_models, models, resample, sweep

PAIRS = list(combinations(range(4), 2))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 4))
    y = (x[:, 0] + 0.7 * x[:, 1] * x[:, 1] + 0.5 * rng.normal(size=700) > 0.5).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, features array<double>, type int").repartition(5).cache()
    return df, x, y


def plain_newton(x, y, name, penalty):
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    p0 = np.append(np.full(x.shape[1], penalty), 0)
    for _ in range(50):
        m = z @ w
        if name == "LOGISTIC":
            p = 1 / (1 + np.exp(-m))
            s, r = p * (1 - p), y - p
        else:
            sign = 2 * y - 1
            s = (sign * m < 1) * 1.0
            r = s * (sign - m)
        w = w + np.linalg.solve(z.T @ (z * s[:, None]) + np.diag(p0 + 1e-9), z.T @ r - p0 * w)
    return w


@pytest.mark.parametrize("name", ["LOGISTIC", "SVM"])
def test_newton_on_all_pairs(table, name):
    df, x, y = table
    got = many_models.fit_many(df, PAIRS, 4, name)
    for c, at in enumerate(PAIRS):
        want = plain_newton(x[:, at], y, name, many_models.PENALTY[name])
        assert np.append(got.weights[c], got.offsets[c]) == pytest.approx(want, rel=1e-5, abs=1e-6)


def plain_tree(x, y, cuts, depth, above=0.5):
    """(share, None) or (factor, cut, left, right)"""
    share = y.mean() if len(y) else above
    best, gini = None, lambda a: 2 * a.sum() * (len(a) - a.sum()) / max(len(a), 1e-300)
    if depth and len(y):
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                left = x[:, f] <= cut
                if 0 < left.sum() < len(y):
                    gain = round(gini(y) - gini(y[left]) - gini(y[~left]), 9)
                    if gain > (best[0] if best else 1e-9):
                        best = (gain, f, cut, left)
    if best is None:
        return share, None
    _, f, cut, left = best
    return f, cut, plain_tree(x[left], y[left], cuts, depth - 1, share), plain_tree(x[~left], y[~left], cuts, depth - 1, share)


def walk(tree, row):
    while tree[1] is not None:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def test_trees_on_all_pairs(table):
    df, x, y = table
    got = many_models.fit_many(df, PAIRS, 4, "DECISIONTREE")
    cuts, scores = many_models.factor_cuts(df, 4), got.scores(x[:200])
    for c, at in enumerate(PAIRS):
        tree = plain_tree(x[:, at], y, cuts[list(at)], many_models.DEPTH)
        assert scores[:, c] == pytest.approx([walk(tree, row) for row in x[:200, at]])


def test_random_trees_count_their_leaves(table):
    df, x, y = table
    got = many_models.fit_many(df, PAIRS, 4, "EXTRA")
    leaves = got.leaves(x, many_models.DEPTH)
    for c, t in ((0, 0), (3, 5), (5, 9)):
        for leaf in set(leaves[:, c, t]):
            assert got.share[c, t, leaf] == pytest.approx(y[leaves[:, c, t] == leaf].mean())
    again = many_models.fit_many(df.repartition(2), PAIRS, 4, "EXTRA")
    assert (again.cut == got.cut).all() and (again.share == got.share).all()
    assert ((got.scores(x)[:, 0] > 0.5) == y).mean() > 0.7


def test_sweep_of_techniques(table):
    df, x, y = table
    marked = resample.split(df)
    rows = sweep.technique_sweep(marked, ["a", "b", "c", "d"], 2).collect()
    assert len(rows) == 5 * 2 * 6 and len({r["id"] for r in rows}) == 60
    by = {(r["technique"], r["correction"], tuple(r["parameters"])): r for r in rows}
    one = models.assess(models.technique("LDA", 2).fit(sweep._pick(marked, (0, 1)).filter("is_train"))(sweep._pick(marked, (0, 1)).filter("not is_train"))).first()
    assert by["LDA", "NONE", ("a", "b")]["accuracy"] == pytest.approx(one["accuracy"]) and by["LDA", "NONE", ("a", "b")]["auc"] == pytest.approx(one["auc"], abs=0.01)
    assert all(by[t, c, ("a", "b")]["auc"] > 0.75 > by[t, c, ("c", "d")]["auc"] for t in ("LDA", "LOGISTIC", "SVM", "DECISIONTREE", "EXTRA") for c in ("NONE", "SMOTE"))
    with pytest.raises(ValueError):
        many_models.fit_many(df, PAIRS, 4, "OTHER")
