"""Season series and their stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.operators.profile import long_form

# 5 percent critical value of the unit-root test with a constant, by sample size.
CRITICAL = (-2.86154, -2.8903, -4.234)


def season_means(df: DataFrame, factors: Sequence[str], by_type: bool = True) -> DataFrame:
    """Mean of each factor per class and date (or per date), one column per factor."""
    keys = ["type", "date"] if by_type else ["date"]
    return df.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in factors])


def unstack(means: DataFrame, factor: str, dates: Sequence) -> DataFrame:
    """One column per date, one row per class; the dates are named so no extra pass looks for them."""
    return means.groupBy("type").pivot("date", list(dates)).agg(F.first(factor))


def stationarity(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Unit-root test per class and factor on the series of date means: change regressed on the level, no extra lags.

    The windows run on date means (one row per day at most), never on raw rows.
    """
    series = long_form(season_means(df, factors), ["type", "date"], factors)
    order = Window.partitionBy("type", "factor").orderBy("date")
    steps = series.withColumn("level", F.lag("value").over(order)).filter("level is not null")
    steps = steps.withColumn("change", F.col("value") - F.col("level"))
    fit = steps.groupBy("type", "factor").agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx("change", "level").alias("sxx"),
        F.regr_sxy("change", "level").alias("sxy"), F.regr_syy("change", "level").alias("syy"))
    slope = F.try_divide("sxy", "sxx")
    error = F.sqrt((F.col("syy") - slope * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    limit = F.lit(CRITICAL[0]) + CRITICAL[1] / F.col("n") + CRITICAL[2] / (F.col("n") * F.col("n"))
    return fit.filter("n > 2").select("type", "factor", "n", F.try_divide(slope, error).alias("t"), limit.alias("limit"))


def stable_factors(tests: DataFrame) -> DataFrame:
    """A factor is stable when crop and weed both fall below the critical value."""
    return tests.filter(F.col("type").isin(0, 1)).groupBy("factor").agg(
        (F.bool_and(F.col("t") < F.col("limit")) & (F.count(F.lit(1)) == 2)).alias("stable"))
