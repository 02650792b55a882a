"""Registry of named queries: each has a Spark form and, where SQL can express it, a checking text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(expression: str, places: int = 6) -> str:
    """SQL text that rounds like :func:`rounded`."""
    return f"(round({expression}, {places}) + 0.0)"


def floats(text: str) -> str:
    """Write decimal literals as floating ones, so that both engines compute in doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column and turn negative zero into zero."""
    return df.select([(F.round(F.col(f"`{n}`"), places) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
                      for n, t in df.dtypes])


def query(name: str, views: str = "", sql: str | None = None, places: int = 6):
    """Register ``fn(views) -> DataFrame``."""
    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: rounded(fn(Views(spark, folder)), places)
        if sql is not None:
            ORACLES[name] = floats(with_views(sql, *views.split()))
        return fn
    return register
