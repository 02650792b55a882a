"""Group statistics and ordered scans that stay parallel when one group is huge.

A plain window function runs one group in one task. The helpers here either aggregate first
(partial aggregation happens before the shuffle) and join the small result back, or cut the
group into ordered chunks and carry totals from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.session import cut_lineage


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add aggregate columns per group. The statistics side has one row per group."""
    named = [column.alias(name) for name, column in stats.items()]
    if not keys:
        packed = df.agg(F.struct(*named).alias("_stats")).scalar()
        return (df.withColumn("_stats", packed)
                .select(*df.columns, *[F.col(f"_stats.{name}").alias(name) for name in stats]))
    stats_side = df.groupBy(*keys).agg(*named)
    return join_keys(df, stats_side, keys).select(*keys, *[c for c in df.columns if c not in keys], *stats)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equality join on ``keys`` in which a null key meets a null key. The right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"__right_{k}" for k in keys])


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool = True) -> DataFrame:
    """The one row per group with the largest (or smallest) order tuple; combines map-side."""
    pick = F.max_by if largest else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    chosen = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def quantile_chunk(df: DataFrame, column: str, chunks: int = 256) -> Column:
    """A monotone chunk number for a numeric column, from approximate quantiles.

    A null has the lowest number, as it sorts first. The driver receives at most ``chunks`` boundaries, whatever the table size. The number comes from a balanced tree
    of comparisons, so it stays in generated code.
    """
    steps = [i / chunks for i in range(1, chunks)]
    bounds = df.agg(F.percentile_approx(F.col(column).cast("double"), steps, 20 * chunks)).first()[0] or []
    limits = sorted(set(bounds))

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) <= limits[middle], place(low, middle)).otherwise(place(middle + 1, high))
    return F.when(F.col(column).isNull(), -1).otherwise(place(0, len(limits)))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], many: int | None = None) -> DataFrame:
    """df as a written table with ``__range``, a number that rises with (keys, order), for :func:`ordered_scan`.

    The ranges come from a sample of all groups together and hold about equally many rows each: a huge group falls into
    many of them, wherever its values lie, and small groups share one.
    """
    many = many or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(many, *keys, *order).withColumn("__range", F.spark_partition_id()))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column, *,
                 lags: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None,
                 last: Mapping[str, Column] | None = None, rank: str | None = None) -> DataFrame:
    """Lag, running sum, last non-null value and row number per group, in order.

    ``chunk`` must not decrease along ``order``. Work inside a chunk is a window over
    (keys, chunk); across chunks only one summary row per chunk is windowed. Rows with a null key are one group, null
    chunks come first, and no row is lost.
    """
    lags, sums, last = dict(lags or {}), dict(sums or {}), dict(last or {})
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    base = df.withColumn("__chunk", chunk)
    for i, column in enumerate(order):
        base = base.withColumn(f"__o{i}", column)
    for name, column in {**lags, **sums, **last}.items():
        base = base.withColumn(f"__in_{name}", column)
    order_columns = [f"__o{i}" for i in range(len(order))]
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order_columns)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)

    out = base.withColumn("__n", F.row_number().over(inside))
    for name in lags:
        out = out.withColumn(f"__l_{name}", F.lag(f"__in_{name}").over(inside))
    for name in sums:
        out = out.withColumn(f"__s_{name}", F.sum(f"__in_{name}").over(running))
    for name in last:
        out = out.withColumn(f"__v_{name}", F.last(f"__in_{name}", ignorenulls=True).over(running))

    position = F.struct(*order_columns)
    summaries = [F.count(F.lit(1)).alias("__rows")]
    if lags:
        summaries.append(F.max_by(F.struct(*[F.col(f"__in_{n}").alias(n) for n in lags]), position).alias("__tail"))
    summaries += [F.sum(f"__in_{n}").alias(f"__t_{n}") for n in sums]
    summaries += [F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), position)).alias(f"__w_{n}") for n in last]
    across = Window.partitionBy(*keys).orderBy("__chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")]
    if lags:
        carried.append(F.lag("__tail").over(across).alias("__prev"))
    carried += [F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__p_{n}") for n in sums]
    carried += [F.last(f"__w_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in last]
    carry = base.groupBy(*keys, "__chunk").agg(*summaries).select(*keys, "__chunk", *carried)

    joined = join_keys(out, carry, [*keys, "__chunk"])
    result = [F.col(c) for c in df.columns]
    result += [F.when(F.col("__n") == 1, F.col(f"__prev.{n}")).otherwise(F.col(f"__l_{n}")).alias(n) for n in lags]
    result += [(F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.col(f"__p_{n}")).alias(n) for n in sums]
    result += [F.coalesce(f"__v_{n}", f"__c_{n}").alias(n) for n in last]
    if rank:
        result.append((F.col("__n") + F.col("__before")).alias(rank))
    return joined.select(*result)
