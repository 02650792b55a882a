"""Profiles and transforms of factor tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.operators.grouped import join_keys, ordered_scan, ranged, with_group_stats


def long_form(df: DataFrame, ids: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """One row per value: ids, factor, value."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in factors]).unpivot(list(ids), list(factors), "factor", "value")


def clean_factors(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Zeros become null and rows with any null are dropped."""
    nulled = df.withColumns({f: F.when(F.col(f) != 0, F.col(f)) for f in factors})
    return nulled.na.drop("any", subset=list(factors))


def dropped_rows(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """How many rows cleaning keeps and drops, in one pass."""
    bad = F.lit(False)
    for f in factors:
        bad = bad | F.coalesce(F.col(f) == 0, F.lit(True))
    return df.agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"))


def tidy_profile(df: DataFrame, factors: Sequence[str], limit: float = 0.9) -> DataFrame:
    """Zeros, share of unique values and whether that share is below the limit, per factor.

    Distinct counting first shrinks to (factor, value), so a table with few factors still spreads out.
    """
    values = long_form(df, [], factors).groupBy("factor", "value").agg(F.count(F.lit(1)).alias("n"))
    out = values.groupBy("factor").agg(
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        (F.count(F.lit(1)) / F.sum("n")).alias("uniqueness"))
    return out.withColumn("drop", F.col("uniqueness") < limit)


def zero_listing(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Zero count of each factor per class, with the class size; one aggregate, then narrow rows."""
    per_class = df.groupBy("type").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f) == 0).alias(f) for f in factors])
    return per_class.unpivot(["type", "rows"], list(factors), "factor", "zeros")


def class_ratio(df: DataFrame) -> DataFrame:
    """Text like ``10:5 CROP:WEED (2.0)``."""
    counts = df.agg(F.count_if(F.col("type") == 0).alias("crop"), F.count_if(F.col("type") == 1).alias("weed"))
    share = F.round(F.try_divide("crop", "weed"), 4)
    return counts.select("crop", "weed", F.concat(F.col("crop").cast("string"), F.lit(":"), F.col("weed").cast("string"),
                                                  F.lit(" CROP:WEED ("), F.format_number(share, 4), F.lit(")")).alias("ratio"))


def normalise_factors(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Min-max per factor over the whole table; a constant factor becomes 1. Statistics come back as one row."""
    stats = {f"_{s}_{f}": fn(f) for f in factors for s, fn in (("lo", F.min), ("hi", F.max))}
    w = with_group_stats(df, [], **stats)
    scaled = [F.when(w[f"_lo_{f}"] == w[f"_hi_{f}"], 1.0).otherwise((w[f] - w[f"_lo_{f}"]) / (w[f"_hi_{f}"] - w[f"_lo_{f}"])).alias(f)
              for f in factors]
    return w.select(*[c for c in df.columns if c not in factors], *scaled)


def factor_variance(df: DataFrame, factors: Sequence[str], population: bool = False) -> DataFrame:
    """Variance per factor as rows; one aggregate over the table."""
    fn = F.var_pop if population else F.var_samp
    return df.agg(*[fn(f).alias(f) for f in factors]).unpivot([], list(factors), "factor", "variance")


def attach_by_position(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Join two short lists row by row. Both hold one row per factor, so the single-task numbering is bounded."""
    number = lambda d, o: d.withColumn("place", F.row_number().over(Window.orderBy(o)))
    return number(left, left_order).join(number(right, right_order), "place")


def factor_correlation(df: DataFrame, factors: Sequence[str], by: str = "type") -> DataFrame:
    """Pearson correlation of every factor pair per class, in one aggregate."""
    pairs = list(combinations(factors, 2))
    wide = df.groupBy(by).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.unpivot([by], [f"{a}|{b}" for a, b in pairs], "pair", "correlation")


def exact_quantiles(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float], chunks: int | None = None) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group: keys, p, quantile. Rows with a null key are one group.

    Works on counts per distinct value and running sums over ranges of values, never on a whole group at once.
    """
    counts = ranged(values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")), keys, ["value"], chunks)
    scanned = ordered_scan(counts, keys, ["value"], F.col("__range"), sums={"upto": F.col("n")})
    scanned = join_keys(scanned, counts.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    spread = scanned.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    place = (F.col("total") - 1) * F.col("p")
    holds = lambda at: (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))
    picked = spread.groupBy(*keys, "p").agg(F.max(F.when(holds(F.floor(place)), F.col("value"))).alias("lo"),
                                            F.max(F.when(holds(F.ceil(place)), F.col("value"))).alias("hi"),
                                            F.max(place - F.floor(place)).alias("part"))
    return picked.select(*keys, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("quantile"))


def value_histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in even bins; the last bin is closed. Values outside are left out."""
    place = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).between(low, high)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, the lower one on a tie."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("m")) \
        .select(*keys, F.col(f"m.{value}").alias("majority"), "m.n")


def band_mean_in_range(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, empty: float = -15000.0) -> DataFrame:
    inside = F.when(F.col(value).between(low, high), F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(inside), F.lit(empty)).alias("mean"))
