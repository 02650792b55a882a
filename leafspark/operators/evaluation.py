"""Evaluation of predictions: confusion tables, ROC curves and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.functions import metrics
from leafspark.operators.grouped import join_keys, ordered_scan, ranged, with_group_stats
from leafspark.session import cut_lineage


def confusion_table(df: DataFrame, keys: Sequence[str], predicted: str = "type", actual: str = "actual") -> DataFrame:
    counts = [c.alias(n) for n, c in metrics.confusion(F.col(predicted), F.col(actual)).items()]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def with_metrics(table: DataFrame, *families) -> DataFrame:
    """Add metric families (functions of tp, fp, tn, fn) to a confusion table."""
    cells = [F.col(c) for c in ("tp", "fp", "tn", "fn")]
    extra = {name: column for family in families for name, column in family(*cells).items()}
    return table.withColumns(extra)


def compare_masks(mask: DataFrame, reference: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Confusion counts of a mask against a reference mask; both: image_id, x, y, v (0 or 1)."""
    pairs = mask.withColumnRenamed("v", "type").join(reference.withColumnRenamed("v", "actual"), ["image_id", "x", "y"])
    return confusion_table(pairs, keys)


def roc_points(df: DataFrame, keys: Sequence[str], score: str = "score", actual: str = "actual",
               chunk: Column | None = None) -> DataFrame:
    """ROC points per group, one per distinct score in falling order: fpr, tpr, threshold.

    Rows with equal scores are counted before the running sums, and the sums run per range of scores. The counts are
    written once, so the rows themselves are read a single time. Rows without a score take no part, in the totals
    neither; :func:`without_score` counts them.
    """
    step = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(actual) == 1).alias("_p"), F.count_if(F.col(actual) != 1).alias("_n"))
    step = ranged(step, keys, [F.col(score).desc()]) if chunk is None else cut_lineage(step)
    chunk = F.col("__range") if chunk is None else chunk
    curve = ordered_scan(step, keys, [-F.col(score)], chunk, sums={"tp": F.col("_p"), "fp": F.col("_n")})
    totals = step.groupBy(*keys).agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    curve = join_keys(curve, totals, keys) if keys else with_group_stats(curve, [], _pos=F.sum("_p"), _neg=F.sum("_n"))
    return curve.select(*keys, F.col(score).alias("threshold"),
                        F.coalesce(F.try_divide("fp", "_neg"), F.lit(0.0)).alias("fpr"),
                        F.coalesce(F.try_divide("tp", "_pos"), F.lit(0.0)).alias("tpr"))


def without_score(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """How many rows of each group have no score and so take no part in its curve."""
    return df.groupBy(*keys).agg(F.count_if(F.col(score).isNull()).alias("without_score"))


def auc(df: DataFrame, keys: Sequence[str], score: str = "score", actual: str = "actual") -> DataFrame:
    """Area under the ROC curve by trapezoids."""
    points = ranged(roc_points(df, keys, score, actual), keys, [F.col("threshold").desc()])
    steps = ordered_scan(points, keys, [-F.col("threshold")], F.col("__range"),
                         lags={"_f": F.col("fpr"), "_t": F.col("tpr")})
    base = lambda c: F.coalesce(c, F.lit(0.0))
    piece = (F.col("fpr") - base("_f")) * (F.col("tpr") + base("_t")) / 2
    return steps.groupBy(*keys).agg(F.sum(piece).alias("auc")) if keys else steps.agg(F.sum(piece).alias("auc"))


def ideal_threshold(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The point where tpr is nearest to 1 - fpr; the higher threshold wins a tie."""
    gap = F.round(F.abs(F.col("tpr") - (1 - F.col("fpr"))), 9)
    best = points.groupBy(*keys).agg(F.min_by(F.struct("threshold", "fpr", "tpr"), F.struct(gap, -F.col("threshold"))).alias("b"))
    return best.select(*keys, "b.*")


def mean_roc(points: DataFrame, keys: Sequence[str], fold: str, steps: int = 100) -> DataFrame:
    """Mean curve over folds on an even grid of false positive rates: fpr, tpr_mean, tpr_std.

    Between two curve points the rate is linear. Each curve segment fills the grid places it spans, so no
    grid is joined against the curve. The first place is 0 and the last is 1, as in the averaged plot.
    """
    group = [*keys, fold]
    corners = cut_lineage(points.groupBy(*group, "fpr").agg(F.max("tpr").alias("hi"), F.min("tpr").alias("lo")))
    start = corners.select(*group).distinct().withColumns({"fpr": F.lit(0.0), "hi": F.lit(0.0), "lo": F.lit(0.0)})
    corners = corners.unionByName(start).groupBy(*group, "fpr").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    seg = ordered_scan(ranged(corners, group, ["fpr"]), group, ["fpr"], F.col("__range"), lags={"f0": F.col("fpr"), "t0": F.col("hi")})
    last = steps - 1
    first_place = F.when(F.col("f0").isNull(), 0).otherwise(F.floor(F.col("f0") * last + 1e-9) + 1)
    final_place = F.floor(F.col("fpr") * last + 1e-9)
    seg = seg.withColumns({"_a": first_place.cast("int"), "_b": final_place.cast("int")}).filter("_a <= _b")
    filled = seg.withColumn("i", F.explode(F.sequence("_a", "_b")))
    x = F.col("i") / float(last)
    exact = F.abs(x - F.col("fpr")) < 1e-9
    line = F.col("t0") + (F.col("lo") - F.col("t0")) * (x - F.col("f0")) / (F.col("fpr") - F.col("f0"))
    value = F.when(F.col("i") == 0, 0.0).when(exact, F.col("hi")).otherwise(line)
    out = filled.groupBy(*keys, "i").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return out.select(*keys, F.col("i").alias("place"), F.when(F.col("i") == last, 1.0).otherwise(F.col("m")).alias("tpr_mean"),
                      F.col("s").alias("tpr_std"))


def correction_delta(results: DataFrame, keys: Sequence[str], measures: Sequence[str], base: str = "NONE") -> DataFrame:
    """Change of each measure against the uncorrected run with the same keys."""
    plain = results.filter(F.col("correction") == base).groupBy(*keys).agg(*[F.max(m).alias(f"_{m}") for m in measures])
    changed = results.filter(F.col("correction") != base)
    changed = join_keys(changed, plain, keys)
    return changed.select(*keys, "correction", *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in measures])
