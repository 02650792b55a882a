"""Batch operators over odometry readings: device, ts, event_id and a reading.

Every operator walks readings in (ts, event_id) order per device, one hour per chunk, so a device with a large
share of all readings is spread over its hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.functions.scalars import haversine_m
from leafspark.operators.grouped import ordered_scan
from leafspark.session import cut_lineage

ORDER = ["ts", "event_id"]


def _hour() -> Column:
    return F.floor(F.unix_seconds(F.col("ts")) / 3600)


def travel(readings: DataFrame, mm_per_degree: float, encoder_clicks: int) -> DataFrame:
    """Millimetres, elapsed seconds, speed, and running distance and pulses; the first angle counts from 0.

    Angle changes add up to the angle itself, so the running totals need no second pass.
    """
    df = ordered_scan(readings, ["device"], ORDER, _hour(), lags={"_angle": F.col("angle"), "_ts": F.col("ts")})
    change = F.col("angle") - F.coalesce("_angle", F.lit(0.0))
    elapsed = (F.unix_micros("ts") - F.unix_micros("_ts")) / 1e6
    df = df.withColumns({"change": change, "mm": change * mm_per_degree, "elapsed": elapsed})
    speed = F.coalesce(F.try_divide(F.col("mm") / 1e6, F.col("elapsed") / 3600), F.lit(0.0))
    return df.withColumns({"kph": speed, "total_mm": F.col("angle") * mm_per_degree,
                           "pulses": F.col("angle") * (360 / encoder_clicks)}).drop("_angle", "_ts")


def moved_angles(readings: DataFrame) -> DataFrame:
    """Readings that are neither zero nor a repeat of the last kept angle."""
    df = ordered_scan(readings.filter("angle <> 0"), ["device"], ORDER, _hour(), lags={"_angle": F.col("angle")})
    return df.filter("_angle is null or angle <> _angle").drop("_angle")


def check_sequence(messages: DataFrame) -> DataFrame:
    """Label each message: reset (-1), duplicate (same number), gap (not the next number) or ok; with the gap size."""
    df = ordered_scan(messages, ["device"], ORDER, _hour(), lags={"_seq": F.col("sequence")})
    current = F.coalesce(F.when(F.col("_seq") == -1, 0).otherwise(F.col("_seq")), F.lit(-1))
    seq = F.col("sequence")
    state = (F.when(seq == -1, "reset").when(seq == current, "duplicate").when(seq != current + 1, "gap").otherwise("ok"))
    return df.withColumns({"state": state, "gap": F.when(state == "gap", seq - (current + 1)).otherwise(0)}).drop("_seq")


def missed_movement(checked: DataFrame, gsd: float, overlap: float = 0.2) -> DataFrame:
    """Gaps in which the device moved more than one image and its overlap. Needs check_sequence and total_mm."""
    df = ordered_scan(cut_lineage(checked), ["device"], ORDER, _hour(), lags={"_total": F.col("total_mm")})
    movement = F.col("total_mm") - F.coalesce("_total", F.lit(0.0))
    return df.withColumn("movement", movement).filter((F.col("state") == "gap") & (movement > gsd * (1 + overlap))).drop("_total")


def fix_distances(fixes: DataFrame) -> DataFrame:
    """Metres between consecutive position fixes of a device; the first fix has none."""
    df = ordered_scan(fixes, ["device"], ORDER, _hour(), lags={"_lat": F.col("lat"), "_lon": F.col("lon")})
    return df.withColumn("metres", haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))) \
        .filter("_lat is not null").drop("_lat", "_lon")


def attach_latest(readings: DataFrame, sensors: DataFrame, columns: list[str]) -> DataFrame:
    """Latest sensor values at or before each reading, per device. One union and one ordered scan, no range join."""
    blank = {c: F.lit(None).cast(sensors.schema[c].dataType) for c in columns}
    side = sensors.select("device", "ts", "event_id", *columns)
    empty = {c: F.lit(None).cast(readings.schema[c].dataType) for c in readings.columns if c not in ("device", "ts", "event_id")}
    both = (readings.withColumns({**blank, "_is_reading": F.lit(True)})
            .unionByName(side.withColumns({**empty, "_is_reading": F.lit(False)})))
    scanned = ordered_scan(both, ["device"], ["ts", "_is_reading", "event_id"], _hour(),
                           last={f"latest_{c}": F.col(c) for c in columns})
    return scanned.filter("_is_reading").drop("_is_reading", *columns)


def counts_by_window(messages: DataFrame, width: str = "1 hour") -> DataFrame:
    """Message counts per kind and tumbling window."""
    return messages.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "kind", "n")
