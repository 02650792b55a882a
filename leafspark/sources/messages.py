"""JSON messages: odometry, treatment, system and target lists. Absent fields take defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# Field names, types and defaults of the messages.
ODOMETRY = [("type", "string", "UNKNOWN"), ("distance", "double", 0.0), ("total_distance", "double", 0.0), ("speed", "double", 0.0),
            ("source", "string", ""), ("action", "string", ""), ("latitude", "double", 0.0), ("longitude", "double", 0.0),
            ("pulses", "double", 0.0), ("gyro", "array<double>", []), ("acceleration", "array<double>", []), ("depth", "double", 0.0),
            ("timestamp", "bigint", 0), ("sequence", "bigint", 0)]
TREATMENT = [("source", "string", ""), ("plan", "string", ""), ("url", "string", ""), ("name", "string", ""), ("position", "string", ""),
             ("tier", "string", ""), ("number", "int", 0), ("pulse_start", "double", 0.0), ("pulse_stop", "double", 0.0),
             ("duration", "double", 0.0), ("timestamp", "bigint", 0), ("sequence", "bigint", 0)]
SYSTEM = [("name", "string", ""), ("action", "string", ""), ("operation", "string", ""), ("result", "string", ""), ("detail", "string", ""),
          ("status-camera", "string", ""), ("status-gps", "string", ""), ("status-system", "string", ""), ("status-intel", "string", ""),
          ("status-odometry", "string", ""), ("status-daq", "string", ""), ("param-gsd", "double", 0.0), ("position", "string", ""),
          ("timestamp", "bigint", 0), ("sequence", "bigint", 0)]
TARGETS = "array<struct<location:array<int>,distance:double>>"
KINDS = {"odometry": ODOMETRY, "treatment": TREATMENT, "system": SYSTEM}


def message_schema(kind: str) -> str:
    return ", ".join(f"`{name}` {type_}" for name, type_, _ in KINDS[kind])


def parse(df: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Message fields as columns; other columns stay."""
    def default(value, type_):
        return F.array().cast(type_) if value == [] else F.lit(value).cast(type_)

    parsed = df.withColumn("_m", F.from_json(column, message_schema(kind)))
    fields = [F.coalesce(F.col(f"_m.`{n}`"), default(d, t)).alias(n) for n, t, d in KINDS[kind]]
    return parsed.select(*[c for c in df.columns if c != column], *fields)


def form(df: DataFrame, kind: str, out: str = "value") -> DataFrame:
    """A JSON text column from the message fields that the table has."""
    names = [n for n, _, _ in KINDS[kind] if n in df.columns]
    return df.withColumn(out, F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])))


def encode_targets(df: DataFrame, keys: list[str], tile: int = 256) -> DataFrame:
    """JSON lists of {location, distance}, ordered by location: keys, part, targets.

    One message for each plane tile of ``tile`` by ``tile`` places that has targets, at every size of an image;
    ``part`` names the tile as "column:row".
    """
    part = F.concat_ws(":", *[F.floor(F.col(c) / tile).cast("string") for c in ("x", "y")])
    target = F.struct(F.array("x", "y").alias("location"), "distance")
    return df.groupBy(*keys, part.alias("part")).agg(F.to_json(F.sort_array(F.collect_list(target))).alias("targets"))


def decode_targets(df: DataFrame, column: str = "targets") -> DataFrame:
    rows = df.select(*[c for c in df.columns if c != column], F.inline(F.from_json(column, TARGETS)))
    return rows.select(*[c for c in df.columns if c != column], F.col("location")[0].alias("x"), F.col("location")[1].alias("y"), "distance")


def event_time(nanoseconds: Column) -> Column:
    """Timestamp from a nanosecond epoch."""
    return F.timestamp_micros((nanoseconds / 1000).cast("long"))


