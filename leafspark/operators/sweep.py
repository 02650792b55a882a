"""Sweeps over factor combinations, techniques and imbalance corrections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.functions import metrics
from leafspark.operators import evaluation, many_models, models, ranking, resample
from leafspark.operators.discriminant import ClassSums
from leafspark.operators.evaluation import roc_points
from leafspark.session import cut_lineage, dealt

BINS = 1024
COMBOS_AT_ONCE = 2000
#: Rows that a task scores at once on so many combinations.
ROWS_AT_ONCE = 512


def discriminant_sweep(train: DataFrame, test: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """Scores of a linear discriminant on every k-factor combination: id, technique, correction, parameters, scores, status.

    Training rows are read once: every combination is solved, inside the tasks, from the same class sums. Test rows are read once per
    2,000 combinations; a batch of rows is scored by one matrix product and leaves as counts per combination and score
    bin, so rows are never multiplied. The auc comes from 1,024 score bins; :func:`rerun_best` gives exact curves.
    """
    sums = ClassSums(train, len(names))
    dims, combos = len(names), math.comb(len(names), k)
    parts = None
    for start in range(0, combos, COMBOS_AT_ONCE):
        def count(batches, start=start):
            chunk = list(islice(combinations(range(dims), k), start, start + COMBOS_AT_ONCE))
            weights, offsets = np.zeros((dims, len(chunk))), np.zeros(len(chunk))
            for c, at in enumerate(chunk):
                weights[list(at), c], offsets[c] = sums.solve(at)
            total = np.zeros((2, len(offsets), BINS), dtype=np.int64)
            for frame in batches:
                if not len(frame):
                    continue
                x, types = np.array([np.asarray(v, dtype=float) for v in frame.features]), frame.type.to_numpy()
                for kind in (0, 1):
                    _add_bins(total[kind], x[types == kind], weights, offsets)
            yield from many_models.counted(total, start)

        counted = test.select("features", "type").mapInPandas(count, "id bigint, place int, actual int, n bigint")
        parts = counted if parts is None else parts.unionByName(counted)
    scored = _from_counts(parts)

    def named(batches):
        for frame in batches:
            if len(frame):
                low, high = int(frame.id.min()), int(frame.id.max())
                run = list(islice(combinations(names, k), low, high + 1))
                yield pd.DataFrame({"id": frame.id, "parameters": [list(run[i - low]) for i in frame.id]})

    lookup = train.sparkSession.range(combos).mapInPandas(named, "id bigint, parameters array<string>")
    return scored.join(lookup, "id").select("id", F.lit("LDA").alias("technique"), F.lit("NONE").alias("correction"), "accuracy", "auc", "precision", "recall",
                                            "f1", F.col("accuracy").alias("map"), "parameters", F.lit(ranking.COMPLETED).alias("status"))


def _add_bins(total: np.ndarray, x: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> None:
    """Count the rows of x in total[combination, score bin], some rows at a time: scores of a whole batch would take 16 KB a row."""
    for row in range(0, len(x), ROWS_AT_ONCE):
        score = 1 / (1 + np.exp(-np.clip(x[row:row + ROWS_AT_ONCE] @ weights + offsets, -500, 500)))
        flat = np.minimum((score * BINS).astype(int), BINS - 1) + np.arange(len(offsets)) * BINS
        total += np.bincount(flat.ravel(), minlength=total.size).reshape(total.shape)


def _from_counts(parts: DataFrame) -> DataFrame:
    """id and its scores from counts of score bins: id, place, actual, n."""
    hist = parts.groupBy("id", "place").agg(F.sum(F.when(F.col("actual") == 1, F.col("n")).otherwise(0)).alias("p"),
                                            F.sum(F.when(F.col("actual") == 0, F.col("n")).otherwise(0)).alias("q"))
    # A combination has at most 1,024 bins, so they fit one array.
    bins = hist.groupBy("id").agg(
        F.sum(F.when(F.col("place") >= BINS // 2, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("place") >= BINS // 2, F.col("q")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("place") < BINS // 2, F.col("q")).otherwise(0)).alias("tn"), F.sum(F.when(F.col("place") < BINS // 2, F.col("p")).otherwise(0)).alias("fn"),
        F.array_sort(F.collect_list(F.struct("place", "p", "q"))).alias("bins"))
    walk = F.aggregate("bins", F.struct(F.lit(0.0).alias("area"), F.lit(0).cast("double").alias("below")), lambda acc, b: F.struct(
        (acc["area"] + b["p"] * (acc["below"] + b["q"] / 2.0)).alias("area"), (acc["below"] + b["q"]).alias("below")))
    pairs = (F.col("tp") + F.col("fn")) * (F.col("fp") + F.col("tn"))
    scored = bins.withColumn("auc", F.coalesce(F.try_divide(walk["area"], pairs), F.lit(0.0)))
    return scored.withColumns(metrics.scores(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def _pick(df: DataFrame, at: Sequence[int]) -> DataFrame:
    return df.withColumn("features", F.array(*[F.element_at("features", i + 1) for i in at]))


def sweep(split_df: DataFrame, combos: Sequence[Sequence[int]], names: Sequence[str], techniques: Sequence[str], corrections: Sequence[str],
          options: dict[str, dict] | None = None) -> DataFrame:
    """Any technique on given combinations, with corrected training rows. One distributed fit per run; one row per run.

    ``split_df`` has ``is_train``.
    """
    out = []
    for correction in corrections:
        for at in combos:
            part = _pick(split_df, at)
            train = resample.correct(part.filter("is_train"), correction).cache()
            for name in techniques:
                scorer = models.technique(name, len(at), **(options or {}).get(name, {})).fit(train)
                r = models.assess(scorer(part.filter("not is_train")), compat=True).first()
                out.append((len(out), name, correction, *[float(r[s]) for s in ranking.SCORES], [names[i] for i in at], ranking.COMPLETED))
            train.unpersist()
    schema = "id bigint, technique string, correction string, " + ", ".join(f"`{s}` double" for s in ranking.SCORES) + ", parameters array<string>, status int"
    return split_df.sparkSession.createDataFrame(out, schema)


def technique_sweep(split_df: DataFrame, names: Sequence[str], k: int, techniques: Sequence[str] = ("LDA", "LOGISTIC", "SVM", "DECISIONTREE", "EXTRA"),
                    corrections: Sequence[str] = ("NONE", "SMOTE")) -> DataFrame:
    """Every technique and correction on every k-factor combination: id, technique, correction, parameters, scores, status.

    All combinations of a technique are fitted in the same few passes over the training rows and scored in one pass over
    the test rows. Training rows are corrected once, on all factors. The auc comes from 1,024 score bins.
    """
    combos = list(combinations(range(len(names)), k))
    test = dealt(split_df.filter("not is_train").select("features", "type"))
    out = None
    for c, correction in enumerate(corrections):
        train = dealt(cut_lineage(resample.correct(split_df.filter("is_train"), correction).select("features", "type")))
        for t, name in enumerate(techniques):
            counts = None
            for start in range(0, len(combos), COMBOS_AT_ONCE):
                model = many_models.fit_many(train, combos[start:start + COMBOS_AT_ONCE], len(names), name)
                part = many_models.score_counts(test, model, BINS).withColumn("id", F.col("id") + start)
                counts = part if counts is None else counts.unionByName(part)
            first = (c * len(techniques) + t) * len(combos)
            scored = cut_lineage(_from_counts(counts)).select((F.col("id") + first).alias("id"), F.lit(name).alias("technique"), F.lit(correction).alias("correction"), F.col("id").alias("_combo"),
                                                              "accuracy", "auc", "precision", "recall", "f1", F.col("accuracy").alias("map"))
            out = scored if out is None else out.unionByName(scored)
    told = split_df.sparkSession.createDataFrame([(i, [names[j] for j in at]) for i, at in enumerate(combos)], "_combo bigint, parameters array<string>")
    return out.join(told, "_combo").select("id", "technique", "correction", *ranking.SCORES, "parameters", F.lit(ranking.COMPLETED).alias("status"))


def imbalance_grid(split_df: DataFrame, dims: int, ratios: Sequence[tuple[float, float]], corrections: Sequence[str], techniques: Sequence[str]) -> DataFrame:
    """Scores per ratio, correction and technique, with the change against the uncorrected run."""
    test = split_df.filter("not is_train")
    out = []
    for crop, weed in ratios:
        uneven = resample.create_imbalance(split_df.filter("is_train"), crop, weed)
        for correction in corrections:
            train = resample.correct(uneven, correction).cache()
            for name in techniques:
                r = models.assess(models.technique(name, dims).fit(train)(test)).first()
                out.append((name, f"{crop}:{weed}", correction, float(r["auc"]), float(r["f1"])))
            train.unpersist()
    results = split_df.sparkSession.createDataFrame(out, "technique string, ratio string, correction string, auc double, f1 double")
    return evaluation.correction_delta(results, ["technique", "ratio"], ["auc", "f1"])


def rerun_best(split_df: DataFrame, results: DataFrame, names: Sequence[str], options: dict[str, dict] | None = None) -> DataFrame:
    """Fit the best run of every technique again, with its own parameters and correction: technique, correction,
    exact auc and ideal threshold, one row per technique. There are as many fits as techniques."""
    scored = None
    for best in ranking.best_rows(results, "auc").orderBy("technique").collect():
        at = [list(names).index(p) for p in best["parameters"]]
        part = _pick(split_df, at)
        train = resample.correct(part.filter("is_train"), best["correction"])
        rows = models.technique(best["technique"], len(at), **(options or {}).get(best["technique"], {})).fit(train)(part.filter("not is_train"))
        rows = rows.select(F.lit(best["technique"]).alias("technique"), F.col("type").alias("actual"), "score")
        scored = rows if scored is None else scored.unionByName(rows)
    scored = cut_lineage(scored)
    ideal = evaluation.ideal_threshold(roc_points(scored, ["technique"]), ["technique"])
    return ideal.join(evaluation.auc(scored, ["technique"]), "technique")
