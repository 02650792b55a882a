"""Classifiers behind one small protocol, and the steps around them.

A technique has ``fit(train)`` and returns a function that adds ``score`` (of class 1) and ``prediction`` to rows.
Tables: id, features (array of double), type (0 crop, 1 weed).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.ml.base import Estimator
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.functions import metrics, rules
from leafspark.operators import discriminant, extra_trees, forests, neighbors
from leafspark.operators.evaluation import auc
from leafspark.operators.resample import hash_share

Scorer = Callable[[DataFrame], DataFrame]


class Technique(Protocol):
    def fit(self, train: DataFrame) -> Scorer: ...


def scale_features(train: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """Features minus the training mean over the training deviation (population); a constant factor is only centered."""
    at = lambda i: F.element_at("features", i + 1)
    stats = train.agg(F.array(*[F.struct(F.avg(at(i)).alias("m"), F.stddev_pop(at(i)).alias("s")) for i in range(dims)]).alias("_s")).scalar()
    scaled = F.zip_with("features", "_s", lambda x, s: (x - s["m"]) / F.when(s["s"] == 0, 1.0).otherwise(s["s"]))
    return rows.withColumn("_s", stats).withColumn("features", scaled).drop("_s")


def _with_vector(df: DataFrame) -> DataFrame:
    return df.withColumns({"vector": array_to_vector("features"), "label": F.col("type").cast("double")})


class Learned:
    """A technique around an estimator of Spark ML with class probabilities."""

    def __init__(self, make: Callable[[DataFrame], Estimator], scale_dims: int | None = None):
        self.make, self.scale_dims = make, scale_dims

    def fit(self, train: DataFrame) -> Scorer:
        ready = lambda d: d if self.scale_dims is None else scale_features(train, d, self.scale_dims)
        data = _with_vector(ready(train))
        model = self.make(data).setFeaturesCol("vector").setLabelCol("label").fit(data)

        def score(rows: DataFrame) -> DataFrame:
            out = model.transform(ready(rows).withColumn("vector", array_to_vector("features")))
            return out.select(*[c for c in rows.columns if c not in ("score", "prediction")],
                              vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))
        return score


class RandomForest:
    """Random trees on one factor a node: of Spark ML on few rows, of :mod:`forests` on more."""

    def __init__(self, trees: int, depth: int = 12, seed: int = 2):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, train: DataFrame) -> Scorer:
        if not forests.few(train.count(), self.trees):
            return forests.RandomTrees(self.trees, self.depth, 1, self.seed).fit(train)
        return Learned(lambda _: RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, featureSubsetStrategy="1", seed=self.seed)).fit(train)


class CalibratedSvm:
    """Linear support vectors; the margin is turned into a probability by a logistic fit."""

    def fit(self, train: DataFrame) -> Scorer:
        data = _with_vector(train)
        svm = LinearSVC(featuresCol="vector", labelCol="label", maxIter=100, regParam=0.01).fit(data)
        margin = lambda d: svm.transform(d).withColumn("margin", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))
        curve = LogisticRegression(featuresCol="margin", labelCol="label", predictionCol="_p", rawPredictionCol="_raw").fit(margin(data).select("margin", "label"))

        def score(rows: DataFrame) -> DataFrame:
            out = curve.transform(margin(rows.withColumn("vector", array_to_vector("features"))))
            return out.select(*rows.columns, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))
        return score


class Discriminant:
    def __init__(self, dims: int):
        self.dims = dims

    def fit(self, train: DataFrame) -> Scorer:
        weights, offset = discriminant.ClassSums(train, self.dims).solve()
        column = discriminant.score_column(weights, offset)
        return lambda rows: rows.withColumn("score", column).withColumn("prediction", (F.col("score") > 0.5).cast("int"))


class Neighbors:
    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, train: DataFrame) -> Scorer:
        return lambda rows: rows.join(neighbors.classify(rows, train, self.k, 1).withColumnRenamed("probability", "score"), "id")


class OneClass:
    """Novelty against the crop rows: distance from their center, cut so that the share ``nu`` of them lies outside.

    A plain distance and not a kernel machine, which is :class:`extra_trees.FourierOneClass`.
    """

    def __init__(self, dims: int, nu: float = 0.99, scaled: bool = True):
        self.dims, self.nu, self.scaled = dims, nu, scaled

    def fit(self, train: DataFrame) -> Scorer:
        at = lambda i: F.element_at("features", i + 1)
        crop = train.filter("type = 0")
        center = crop.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(self.dims)], *[F.stddev_pop(at(i)).alias(f"s{i}") for i in range(self.dims)]).first()
        size = lambda i: (center[f"s{i}"] or 1.0) if self.scaled else 1.0
        distance: Column = F.sqrt(reduce(lambda a, b: a + b, [F.pow((at(i) - (center[f"m{i}"] or 0.0)) / size(i), F.lit(2)) for i in range(self.dims)]))
        cut = crop.agg(F.percentile_approx(distance, 1 - self.nu, 10000)).first()[0] or 0.0
        return lambda rows: rows.withColumn("score", distance / (distance + 1)).withColumn("prediction", (distance > cut).cast("int"))


def _logistic(data: DataFrame) -> Estimator:
    return LogisticRegression(maxIter=500, regParam=1 / (100.0 * max(data.count(), 1)), standardization=False)


def technique(name: str, dims: int, **options) -> Technique:
    """A technique by name. Tree counts and boosting rounds can be given."""
    name = name.upper()
    makers = {
        "LOGISTIC": lambda: Learned(_logistic),
        "DECISIONTREE": lambda: Learned(lambda _: DecisionTreeClassifier(maxDepth=15, seed=0)),
        "RANDOMFOREST": lambda: RandomForest(options.get("trees", 1000)),
        "GRADIENT": lambda: Learned(lambda _: GBTClassifier(maxDepth=4, maxIter=options.get("rounds", 100), seed=0)),
        "EXTRA": lambda: extra_trees.ExtraTrees(dims, options.get("trees", 100)),
        "SVM": CalibratedSvm,
        "MLP": lambda: Learned(lambda _: MultilayerPerceptronClassifier(layers=[dims, 20, 2], solver="gd", stepSize=0.3, maxIter=options.get("rounds", 100), seed=42), dims),
        "LDA": lambda: Discriminant(dims), "KNN": Neighbors,
        "OCC": lambda: extra_trees.FourierOneClass(dims), "OCC_DISTANCE": lambda: OneClass(dims), "OCCSGD": lambda: OneClass(dims, scaled=False)}
    if name not in makers:
        raise ValueError(f"unknown technique {name!r}; known: {sorted(makers)}")
    return makers[name]()


def assess(scored: DataFrame, compat: bool = False) -> DataFrame:
    """One row with counts, accuracy, precision, recall, f1, map and auc.

    ``compat``: when every prediction is 0, the row with the lowest id counts as predicted 1.
    """
    counts = scored.agg(*[c.alias(n) for n, c in metrics.confusion(F.col("prediction"), F.col("type")).items()], F.min_by("type", "id").alias("_first"))
    if compat:
        none = (F.col("tp") + F.col("fp")) == 0
        up = F.when(none & (F.col("_first") == 1), 1).otherwise(0)
        down = F.when(none & (F.col("_first") == 0), 1).otherwise(0)
        counts = counts.withColumns({"tp": F.col("tp") + up, "fn": F.col("fn") - up, "fp": F.col("fp") + down, "tn": F.col("tn") - down})
    cells = [F.col(c) for c in ("tp", "fp", "tn", "fn")]
    table = counts.drop("_first").withColumns(metrics.scores(*cells))
    area = auc(scored.select("score", F.col("type").alias("actual")), []).scalar()
    return table.withColumns({"map": F.col("accuracy"), "auc": area})


def cross_validate(df: DataFrame, method: Technique, folds: int = 5) -> DataFrame:
    """Accuracy per fold; folds by hash of the id, one fit per fold."""
    marked = df.withColumn("_fold", F.floor(hash_share(F.col("id"), 7) * folds))
    parts = []
    for fold in range(folds):
        scorer = method.fit(marked.filter(F.col("_fold") != fold).drop("_fold"))
        scored = scorer(marked.filter(F.col("_fold") == fold).drop("_fold"))
        parts.append(scored.agg(F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("rows"),
                                F.avg((F.col("prediction") == F.col("type")).cast("double")).alias("accuracy")))
    return reduce(DataFrame.unionByName, parts)


def score_rows(scorer: Scorer, rows: DataFrame, reason: int) -> DataFrame:
    """Predicted types; rows at the image edge keep type and reason."""
    scored = scorer(rows)
    edge = F.col("reason") == rules.REASON_AT_EDGE
    return scored.withColumns({"type": F.when(edge, F.col("type")).otherwise(F.col("prediction")),
                               "reason": F.when(edge, F.col("reason")).otherwise(reason)})


def classify_pixels(scorer: Scorer, pixels: DataFrame, bands: dict[str, Column]) -> DataFrame:
    """Pixels with ground (class 1) set to black; features are the given bands."""
    scored = scorer(pixels.withColumn("features", F.array(*[c.cast("double") for c in bands.values()])))
    ground = F.col("prediction") == 1
    return scored.select("image_id", "x", "y", *[F.when(ground, 0).otherwise(F.col(c)).alias(c) for c in "rgb"])
