"""Queries read every date, factor and tree that their tables and defaults have."""

import inspect

import numpy as np

from leafspark.operators import resample, selection
from leafspark.plans import catalog, catalog_learning, catalog_tables


def test_unstack_has_every_date(spark, views):
    dates = {str(r["date"]) for r in views.season.select("date").distinct().collect()}
    got = catalog.QUERIES["agg12_unstack_all"](spark, "/root/testdata/sf0.001")
    assert set(got.columns) == {"type"} | dates and len(dates) > len(catalog_tables.MONTHS)


def test_recursive_selectors_use_the_default_trees(spark, views, monkeypatch):
    seen = []
    monkeypatch.setattr(selection, "_forest", lambda df, trees, at: seen.append(trees) or [float(i) for i in range(len(at))])
    catalog.QUERIES["ml30_recursive"](spark, "/root/testdata/sf0.001")
    catalog.QUERIES["ml32_all_selectors"](spark, "/root/testdata/sf0.001")
    defaults = [inspect.signature(f).parameters["trees"].default for f in (selection.recursive, selection.importance)]
    assert defaults == [100, 10] and seen.count(100) == 2 * 63 and seen.count(10) == 1 and len(seen) == 127


def test_sweeps_combine_all_factors(spark, monkeypatch):
    seen = []
    real = catalog_learning.sweep.discriminant_sweep

    def noted(train, test, names, k):
        seen.append((len(names), k))
        return real(train, test, names, k)
    monkeypatch.setattr(catalog_learning.sweep, "discriminant_sweep", noted)
    monkeypatch.setattr(catalog_learning.sweep, "sweep", lambda df, *_: spark.createDataFrame([], real(df, df, ["a", "b"], 1).schema))
    monkeypatch.setattr(catalog_learning.sweep, "rerun_best", lambda df, results, names: results)
    catalog.QUERIES["ml33_sweep"](spark, "/root/testdata/sf0.001")
    pairs = catalog.QUERIES["ml35_rerun_best"](spark, "/root/testdata/sf0.001")
    assert seen == [(64, 3), (64, 2)] and pairs.count() == 2016


def test_discriminants_of_all_factors(spark, views):
    rows = resample.split(views.vectors).select("id", "type", "features", "is_train").collect()
    train = [r for r in rows if r["is_train"]]
    x = {t: np.array([r["features"] for r in train if r["type"] == t], float) for t in (0, 1)}
    mean = {t: x[t].mean(0) for t in x}
    pooled = sum((x[t] - mean[t]).T @ (x[t] - mean[t]) for t in x) / (len(train) - 2)
    w = np.linalg.solve(pooled, mean[1] - mean[0])
    offset = np.log(len(x[1]) / len(x[0])) - 0.5 * (mean[0] + mean[1]) @ w
    want = {r["id"]: 1 / (1 + np.exp(-(np.array(r["features"], float) @ w + offset))) for r in rows if not r["is_train"]}
    got = {r["id"]: r for r in catalog.QUERIES["ml10_lda_all"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(abs(got[i]["score"] - want[i]) < 1e-5 for i in want)
    scores = catalog.QUERIES["ml14_assess_all"](spark, "/root/testdata/sf0.001").first()
    assert scores["tp"] + scores["fp"] + scores["tn"] + scores["fn"] == len(want)
    typed = {r["id"]: r["type"] for r in catalog.QUERIES["ml15_score_rows_all"](spark, "/root/testdata/sf0.001").collect()}
    assert all(typed[i] == (4 if i % 10 == 0 else got[i]["prediction"]) for i in want)


def test_a_group_in_a_narrow_range_splits(spark):
    """Scores of one group that all lie in one 1/256 still fall into several ranges, in order; null keys keep their rows."""
    from pyspark.sql import functions as F

    from leafspark.operators import evaluation, profile
    from leafspark.operators.grouped import ranged
    rows = spark.range(4000).select(F.when(F.col("id") < 3600, 1).otherwise(F.when(F.col("id") < 3800, 2)).alias("k"), (F.lit(0.5) + F.col("id") / 4e6).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("actual"))
    cut = ranged(rows, ["k"], [F.col("score").desc()], 8)
    parts = {r["__range"]: (r["lo"], r["hi"]) for r in cut.filter("k = 1").groupBy("__range").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
    assert len(parts) >= 5 and all(parts[a][0] > parts[b][1] for a, b in zip(sorted(parts), sorted(parts)[1:]))
    areas = {r["k"]: r["auc"] for r in evaluation.auc(rows, ["k"]).collect()}
    assert set(areas) == {1, 2, None}
    plain = [(r["score"], r["actual"]) for r in rows.filter("k = 1").collect()]
    ones, zeros = sorted(s for s, a in plain if a), sorted(s for s, a in plain if not a)
    import bisect
    assert abs(areas[1] - sum(bisect.bisect_left(zeros, s) for s in ones) / len(ones) / len(zeros)) < 1e-9
    found = {(r["k"], r["p"]): r["quantile"] for r in profile.exact_quantiles(rows.select("k", F.col("score").alias("value")), ["k"], [0.5]).collect()}
    assert set(found) == {(1, 0.5), (2, 0.5), (None, 0.5)} and abs(found[None, 0.5] - (0.5 + 3899.5 / 4e6)) < 1e-12
