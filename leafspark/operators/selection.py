"""Factor selection: each selector gives a table (factor, score)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.operators import forests
from leafspark.session import dealt


class Selector(Protocol):
    name: str

    def create(self) -> None: ...

    def analyze(self, df: DataFrame, names: Sequence[str]) -> DataFrame: ...


def _wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select("type", *[F.element_at("features", i + 1).alias(n) for i, n in enumerate(names)])


def _table(df: DataFrame, names: Sequence[str], scores: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n, float(s)) for n, s in zip(names, scores)], "factor string, score double")


def variance(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return _wide(df, names).agg(*[F.var_pop(n).alias(n) for n in names]).unpivot([], list(names), "factor", "score")


def univariate(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-way F value per factor, from per-class counts, means and variances in one aggregation."""
    per_class = _wide(df, names).groupBy("type").agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.avg(n).alias("m"), F.var_pop(n).alias("v")).alias(n) for n in names])
    rows = per_class.unpivot(["type", "n"], list(names), "factor", "s").select("factor", "n", F.col("s.m").alias("m"), F.col("s.v").alias("v"))
    sums = rows.groupBy("factor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"),
                                      F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    return sums.select("factor", F.try_divide(between, F.col("w") / (F.col("n") - F.col("k"))).alias("score"))


def pca(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of variance explained per component; component i is listed under factor i."""
    data = df.select(array_to_vector("features").alias("vector"))
    model = PCA(k=len(names), inputCol="vector", outputCol="out").fit(data)
    return _table(df, names, model.explainedVariance.toArray())


def _forest(df: DataFrame, trees: int, keep: Sequence[int]):
    picked = F.array(*[F.element_at("features", i + 1) for i in keep])
    data = df.select(array_to_vector(picked).alias("vector"), F.col("type").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=8, seed=42).fit(data).featureImportances.toArray()


def importance(df: DataFrame, names: Sequence[str], trees: int = 10) -> DataFrame:
    return _table(df, names, _forest(df, trees, range(len(names))))


def recursive(df: DataFrame, names: Sequence[str], trees: int = 100) -> DataFrame:
    """Elimination rank: 1 is the last factor left. One fit per dropped factor, all on one written table; that of a large
    table holds the bins of the factors."""
    df = dealt(df.select("features", "type"))
    binned = None if forests.few(df.count(), trees) else forests.Binned(df)
    left, rank = list(range(len(names))), {}
    while len(left) > 1:
        weights = _forest(df, trees, left) if binned is None else forests.importances(binned, left, trees)
        drop = left[min(range(len(left)), key=lambda i: (weights[i], -i))]
        rank[drop] = len(left)
        left.remove(drop)
    rank[left[0]] = 1
    return _table(df, names, [rank[i] for i in range(len(names))])


class ColumnSelector:
    """A selector from one aggregate expression per factor."""

    def __init__(self, name: str, measure: Callable[[Column], Column]):
        self.name, self.measure = name, measure

    def create(self) -> None:
        return None

    def analyze(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return _wide(df, names).agg(*[self.measure(F.col(n)).alias(n) for n in names]).unpivot([], list(names), "factor", "score")


def run_selector(selector: Selector, df: DataFrame, names: Sequence[str]) -> DataFrame:
    selector.create()
    return selector.analyze(df, names)


SELECTORS = {"Importance": importance, "PCA": pca, "Recursive": recursive, "Univariate": univariate, "Variance": variance}


def all_selectors(df: DataFrame, names: Sequence[str], options: dict[str, dict] | None = None) -> DataFrame:
    """One row per factor and one score column per selector."""
    options = options or {}
    parts = [fn(df, names, **options.get(n, {})).select("factor", F.lit(n).alias("selector"), "score") for n, fn in SELECTORS.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("factor").pivot("selector", list(SELECTORS)).agg(F.first("score"))
