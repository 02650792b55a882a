"""Reduction of sweep results to ranked tables.

A results row: id, technique, correction, accuracy, auc, precision, recall, f1, map, parameters, status.
The "map" score equals accuracy; the name is kept for compatibility.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.scalars import bag_cosine
from leafspark.operators.grouped import top_by, with_group_stats

# Technique families, scores and status codes.
BINARY = ["RANDOMFOREST", "KNN", "GRADIENT", "LDA", "SVM", "LOGISTIC", "MLP", "DECISIONTREE", "EXTRA"]
ONE_CLASS = ["OCC", "OCCSGD"]
SCORES = ["accuracy", "auc", "precision", "recall", "f1", "map"]
SUMMARY_SCORES = ["precision", "recall", "f1", "map", "auc"]
COMPLETED = 2


def completed(results: DataFrame, family: Sequence[str] = tuple(BINARY)) -> DataFrame:
    return results.filter((F.col("status") == COMPLETED) & F.col("technique").isin(*family))


def best_rows(results: DataFrame, criterion: str, keys: Sequence[str] = ("technique",)) -> DataFrame:
    """Best row per technique; the lower id wins a tie."""
    return top_by(results, keys, [F.col(criterion), -F.col("id")])


def highest_scores(results: DataFrame) -> DataFrame:
    return results.groupBy("technique").agg(*[F.max(s).alias(s) for s in SCORES])


def close_to_highest(results: DataFrame, tolerance: float) -> DataFrame:
    """Percent of results within a relative tolerance of the technique's highest score, per score."""
    r = with_group_stats(results, ["technique"], **{f"_{s}": F.max(s) for s in SCORES})
    near = lambda s: F.abs(r[s] - r[f"_{s}"]) <= F.greatest(F.abs(r[s]), F.abs(r[f"_{s}"])) * tolerance
    return r.groupBy("technique").agg(*[(F.count_if(near(s)) * 100 / F.count(F.lit(1))).alias(s) for s in SCORES])


def parameter_counts(best: DataFrame) -> DataFrame:
    """How many of the best models use each parameter."""
    return best.select(F.explode(F.col("parameters")).alias("parameter")).groupBy("parameter").agg(F.count(F.lit(1)).alias("n"))


def summary(results: DataFrame) -> DataFrame:
    """Average of the distinct per-score best rows of each technique, in one aggregation."""
    row = F.struct("id", *SUMMARY_SCORES)
    best = [F.max_by(row, F.struct(F.col(s), -F.col("id"))).alias(s) for s in SUMMARY_SCORES]
    picks = results.groupBy("technique").agg(*best).select("technique", F.explode(F.array_distinct(F.array(*SUMMARY_SCORES))).alias("r"))
    return picks.groupBy("technique").agg(F.count(F.lit(1)).alias("models"), *[F.avg(f"r.{s}").alias(s) for s in SUMMARY_SCORES])


def running_maximum(results: DataFrame) -> DataFrame:
    """Highest score per technique and criterion, with the parameters and correction that gave it."""
    best = [F.max_by(F.struct(F.col(s).alias("result"), "id", "parameters", "correction"), F.struct(F.col(s), -F.col("id"))).alias(s)
            for s in SCORES]
    rows = [F.struct(F.lit(s).alias("criterion"), F.col(s).alias("best")) for s in SCORES]
    return results.groupBy("technique").agg(*best).select("technique", F.inline(F.array(*rows))).select("technique", "criterion", "best.*")


def top_with_equals(results: DataFrame, criterion: str, n: int) -> DataFrame:
    """The n highest distinct scores: the first row of each is the winner, the rest are its equals.

    The n scores come from a top-n over distinct scores, at most n rows, so the join back is a broadcast of known size.
    """
    scores = results.select(criterion).distinct().orderBy(F.desc(criterion)).limit(n)
    places = scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc(criterion))).cast("long"))
    rows = results.join(F.broadcast(places), criterion)
    winners = rows.groupBy("place").agg(F.min("id").alias("_winner"))
    return rows.join(F.broadcast(winners), "place").select("place", "id", "technique", criterion, (F.col("id") == F.col("_winner")).alias("winner"))


def top_factors(ranks: DataFrame, selector: str, score: str, n: int, ascending: bool = False) -> DataFrame:
    """First n factors per selector."""
    order = Window.partitionBy(selector).orderBy(F.asc(score) if ascending else F.desc(score), "factor")
    return ranks.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def similar_to(results: DataFrame, selector_factors: dict[str, list[str]], minimum: float) -> DataFrame:
    """Completed rows whose parameters resemble at least one selector's factor list; distinct rows."""
    sims = {name: bag_cosine(F.col("parameters"), F.array(*[F.lit(f) for f in factors])) for name, factors in selector_factors.items()}
    r = results.filter(F.col("status") == COMPLETED).withColumns(sims)
    return r.filter(F.greatest(*[F.col(n) for n in sims]) >= minimum if len(sims) > 1 else F.col(next(iter(sims))) >= minimum) \
        .select("technique", "accuracy", *sims).dropDuplicates()


def composed_of(results: DataFrame, catalog: DataFrame, types: Sequence[str], subtypes: Sequence[str] | None = None) -> DataFrame:
    """Rows whose parameters are all of the given types (and subtypes). The catalogue has under 200 rows."""
    wanted = catalog.filter(F.col("kind") == "SCALAR")
    wanted = wanted.filter(F.col("type").isin(*types)) if types else wanted
    wanted = wanted.filter(F.col("subtype").isin(*subtypes)) if subtypes else wanted
    allowed = wanted.agg(F.collect_set("factor").alias("_allowed")).scalar()
    return results.filter(F.size(F.array_except("parameters", allowed)) == 0)


def combinations_of(factors: DataFrame, k: int) -> DataFrame:
    """All k-element combinations of the distinct factors: combo_id, factors.

    ``factors`` is a catalogue-sized list (one column, factor). It becomes one sorted array on a single row; each
    round appends every later factor to the partial combinations, and rounds are spread over the tasks.
    """
    spark = factors.sparkSession
    start = factors.agg(F.array_sort(F.collect_set("factor")).alias("names"))
    df = start.select("names", F.explode(F.sequence(F.lit(1), F.size("names"))).alias("i")).select("names", F.array("i").alias("picked"))
    for _ in range(k - 1):
        last = F.element_at("picked", -1)
        later = F.when(last < F.size("names"), F.sequence(last + 1, F.size("names"))).otherwise(F.array().cast("array<int>"))
        df = df.repartition(spark.sparkContext.defaultParallelism, "picked")
        df = df.select("names", "picked", F.explode(later).alias("i")).select("names", F.concat("picked", F.array("i")).alias("picked"))
    named = F.transform("picked", lambda i: F.element_at("names", i))
    return df.select(F.concat_ws("-", F.transform("picked", lambda i: i.cast("string"))).alias("combo_id"), named.alias("factors"))


def batched(df: DataFrame, key: str, size: int) -> DataFrame:
    """Batch number for a dense numeric key."""
    return df.withColumn("batch", F.floor(F.col(key) / size))
