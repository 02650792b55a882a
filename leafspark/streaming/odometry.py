"""Streaming operators over odometry, and batch twins that give the same rows.

Each operator is a fold: from a small state and the next readings of one device, in order, to a new state and output
rows. In a stream the state lives in the state store, with the readings that the watermark has not passed yet: they are
folded in event order once it has, so readings may come out of order by up to ``delay`` (none by default) and come out
that much later. Still later ones are dropped and counted by the stream's progress (numRowsDroppedByWatermark). In batch, readings are sorted per device and flow through the
same fold batch by batch, so a device is never held in memory as a whole. Reset-on-threshold state depends on every
reading before it, so the readings of one device are walked in sequence by definition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafspark.functions.rules import is_fresh

Fold = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]
ORDER = ["ts", "event_id"]


def _pack(rows: pd.DataFrame) -> bytes:
    return pickle.dumps(rows)


def _unpack(held: bytes) -> pd.DataFrame:
    return pickle.loads(held)


def _stamps(rows: pd.DataFrame, unit: str) -> np.ndarray:
    return rows.ts.to_numpy().astype(f"datetime64[{unit}]").astype("int64")


def _in_order(rows: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """Rows by the order's columns, nulls last, equal ones as they came. A stream has many devices of few readings, so this
    and the folds work on plain arrays."""
    columns = [rows[c].to_numpy() for c in order]
    if any(c.dtype == object for c in columns):
        return rows.sort_values(order, kind="stable").reset_index(drop=True)
    at = np.lexsort(columns[::-1])
    return rows if (at == np.arange(len(at))).all() else rows.take(at).reset_index(drop=True)


def _batch(readings: DataFrame, fold: Fold, start: tuple, schema: str, order: list[str]) -> DataFrame:
    """Devices travel as text that is never null, so readings without a device are one device and ids keep all digits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, state = None, start
        for frame in batches:
            for key, part in frame.groupby("device", sort=False):
                if key != device:
                    device, state = key, start
                state, out = fold(state, part.reset_index(drop=True))
                if len(out):
                    yield out
    kind = readings.schema["device"].dataType.simpleString()
    named = readings.withColumn("device", F.coalesce(F.concat(F.lit("="), F.col("device").cast("string")), F.lit("")))
    typed = ", ".join("device string" if c.strip().startswith("device ") else c for c in schema.split(","))
    folded = named.repartition("device").sortWithinPartitions("device", *order).mapInPandas(run, typed)
    return folded.withColumn("device", F.when(F.col("device") != "", F.substr(F.col("device"), F.lit(2)).cast(kind)))


def _stream(readings: DataFrame, fold: Fold, start: tuple, schema: str, state_schema: str, order: list[str]) -> DataFrame:
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *now, held = state.get if state.exists else (*start, None)
        rows = [_unpack(held)] if held else []
        if not state.hasTimedOut:
            rows += list(frames)
        rows = _in_order(rows[0].reset_index(drop=True) if len(rows) == 1 else pd.concat(rows, ignore_index=True), order)
        passed = state.getCurrentWatermarkMs()
        stamp = _stamps(rows, "ms")
        due = stamp <= passed
        ready, later = (rows, rows.iloc[:0]) if due.all() else (rows.iloc[:0], rows) if not due.any() else (rows[due].reset_index(drop=True), rows[~due])
        if len(ready):
            now, out = fold(tuple(now), ready)
            if len(out):
                yield out
        state.update((*now, _pack(later) if len(later) else None))
        if len(later):
            # The timeout comes when the watermark is past it, so it lies just before the first reading that is held.
            state.setTimeoutTimestamp(max(int(stamp[~due].min()) - 1, passed + 1))
    return readings.groupBy("device").applyInPandasWithState(run, schema, state_schema + ", held binary", "append", GroupStateTimeout.EventTimeTimeout)


def _apply(readings: DataFrame, fold: Fold, start: tuple, schema: str, state_schema: str, delay: str, order: list[str] = ORDER) -> DataFrame:
    if readings.isStreaming:
        return _stream(readings.withWatermark("ts", delay), fold, start, schema, state_schema, order)
    return _batch(readings, fold, start, schema, order)


def travel(readings: DataFrame, mm_per_degree: float, encoder_clicks: int, delay: str = "0 seconds") -> DataFrame:
    """Per reading: mm, speed, running distance and pulses. readings: device, ts, event_id, angle."""
    def fold(state, frame):
        angle, then, total, pulses = state
        angles, stamp = frame.angle.to_numpy(dtype=float), _stamps(frame, "us")
        change = np.diff(angles, prepend=angle)
        seconds = np.diff(stamp, prepend=then) / 1e6
        if then < 0:
            seconds[0] = np.nan
        mm = change * mm_per_degree
        with np.errstate(all="ignore"):
            kph = np.where(seconds > 0, (mm / 1e6) / (seconds / 3600), 0.0)
        run = lambda v: np.where(np.isnan(v), np.nan, np.cumsum(np.where(np.isnan(v), 0.0, v)))  # a reading without a value has no sum
        total, pulses = total + run(mm), pulses + run(change * (360 / encoder_clicks))
        out = pd.DataFrame({"device": frame.device, "event_id": frame.event_id, "ts": frame.ts, "mm": mm, "kph": kph, "total_mm": total, "pulses": pulses})
        return (float(angles[-1]), int(stamp[-1]), float(total[-1]), float(pulses[-1])), out
    return _apply(readings, fold, (0.0, -1, 0.0, 0.0), "device bigint, event_id bigint, ts timestamp, mm double, kph double, total_mm double, pulses double",
                  "angle double, stamp bigint, total double, pulses double", delay)


def announce(moves: DataFrame, every_mm: float, delay: str = "0 seconds") -> DataFrame:
    """A message when the distance since the last one reaches ``every_mm`` either way. moves: device, ts, event_id, mm."""
    def fold(state, frame):
        since, total, sequence = state
        rows = []
        for device, ts, event_id, mm in zip(frame.device, frame.ts, frame.event_id, frame.mm):
            since += mm
            total += mm
            if abs(since) >= every_mm:
                sequence += 1
                rows.append((device, event_id, ts, since, total, sequence))
                since = 0.0
        return (since, total, sequence), pd.DataFrame(rows, columns=["device", "event_id", "ts", "distance", "total_mm", "sequence"])
    return _apply(moves, fold, (0.0, 0.0, 0), "device bigint, event_id bigint, ts timestamp, distance double, total_mm double, sequence bigint",
                  "since double, total double, sequence bigint", delay)


def captures(messages: DataFrame, gsd: dict[str, float], overlap: float = 0.2, delay: str = "0 seconds") -> DataFrame:
    """Capture and alert rows per camera. messages: device, ts, event_id, sequence, total_mm, latitude, longitude, kph.

    A camera takes an image when the device moved more than its ground distance since its last image. Resets and
    duplicates are skipped; a gap in the numbers with more movement than one image and its overlap raises an alert.
    """
    cameras = sorted(gsd)

    def fold(state, frame):
        current, seen, *last = state
        rows = []
        for m in frame.itertuples(index=False):
            if m.sequence == -1:
                current = 0
                continue
            if m.sequence == current:
                continue
            gap = m.sequence != current + 1
            for i, camera in enumerate(cameras):
                moved = m.total_mm - last[i]
                place = (m.device, m.event_id, m.ts, camera)
                if gap and seen and moved > gsd[camera] * (1 + overlap):
                    rows.append((*place, "alert", moved, m.latitude, m.longitude, m.kph))
                if moved > gsd[camera]:
                    last[i] = m.total_mm
                    rows.append((*place, "capture", moved, m.latitude, m.longitude, m.kph))
            current, seen = m.sequence, seen + 1
        names = ["device", "event_id", "ts", "camera", "kind", "movement", "latitude", "longitude", "kph"]
        return (int(current), int(seen), *[float(v) for v in last]), pd.DataFrame(rows, columns=names)
    return _apply(messages, fold, (-1, 0, *[0.0 for _ in cameras]),
                  "device bigint, event_id bigint, ts timestamp, camera string, kind string, movement double, latitude double, longitude double, kph double",
                  "current bigint, seen bigint, " + ", ".join(f"last{i} double" for i in range(len(cameras))), delay)


def fresh_only(messages: DataFrame, received: str = "received", delay: str = "5 seconds") -> DataFrame:
    """Messages younger than five seconds on arrival; the watermark lets later steps forget older ones."""
    marked = messages.withWatermark("ts", delay) if messages.isStreaming else messages
    return marked.filter(is_fresh(F.col("ts"), F.col(received)))


def count_messages(messages: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Message counts per kind and tumbling window."""
    marked = messages.withWatermark("ts", delay) if messages.isStreaming else messages
    return marked.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def first_of_sequence(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Without repeats of a device's sequence number inside the watermark."""
    marked = messages.withWatermark("ts", delay) if messages.isStreaming else messages
    return marked.dropDuplicatesWithinWatermark(["device", "sequence"]) if messages.isStreaming else marked.dropDuplicates(["device", "sequence"])


def attach_position(captured: DataFrame, fixes: DataFrame, within: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Captures with every position fix of the same device up to ``within`` before them; an interval join. For the one
    position of a capture see :func:`latest_position`."""
    stream = captured.isStreaming
    c = (captured.withWatermark("ts", delay) if stream else captured).alias("c")
    f = (fixes.withWatermark("fix_ts", delay) if stream else fixes).alias("f")
    near = F.expr(f"c.device = f.device and f.fix_ts <= c.ts and f.fix_ts >= c.ts - interval {within}")
    return c.join(f, near).select("c.*", "f.fix_ts", "f.latitude", "f.longitude")


def latest_position(captured: DataFrame, fixes: DataFrame, within_seconds: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """Every capture once, with the latest position fix of its device: the columns of captured, fix_ts, latitude, longitude.

    Captures (device, ts, event_id, ...) and fixes (device, fix_ts, latitude, longitude) are one sequence of events; the
    state of a device is its latest fix, and a fix of the same moment comes first (of several fixes the one with the largest coordinates counts). A capture whose latest fix is older than
    ``within_seconds``, or that has none, has nulls. Events without a device are those of one device.
    """
    kind = captured.schema["device"].dataType.simpleString()
    rows = captured.select("device", "ts", F.lit(1).alias("late"), "event_id", F.struct(*captured.columns).alias("capture"),
                           F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    told = fixes.select(F.col("device").cast(kind).alias("device"), F.col("fix_ts").alias("ts"), F.lit(0).alias("late"), F.lit(0).cast(captured.schema["event_id"].dataType).alias("event_id"),
                        F.lit(None).cast(rows.schema["capture"].dataType).alias("capture"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    events = rows.unionByName(told)

    def fold(state, frame):
        stamp = _stamps(frame, "us")
        fix = frame.late.to_numpy() == 0
        # Row 0 is the state; each event takes the last fix up to it.
        last = np.maximum.accumulate(np.where(fix, np.arange(1, len(fix) + 1), 0))
        columns = (stamp, frame.latitude.to_numpy(dtype=float), frame.longitude.to_numpy(dtype=float))
        then, lat, lon = (np.append(old, new)[last] for old, new in zip(state, columns))
        good = (then >= 0) & (stamp - then <= within_seconds * 1e6)
        found = np.where(good, then.astype("datetime64[us]"), np.datetime64("NaT")).astype("datetime64[ns]")
        out = pd.DataFrame({"device": frame.device, "capture": frame.capture, "fix_ts": found, "latitude": np.where(good, lat, np.nan), "longitude": np.where(good, lon, np.nan)})
        return (int(then[-1]), float(lat[-1]), float(lon[-1])), out[~fix]
    schema = f"device {kind}, capture {rows.schema['capture'].dataType.simpleString()}, fix_ts timestamp, latitude double, longitude double"
    found = _apply(events, fold, (-1, 0.0, 0.0), schema, "stamp bigint, latitude double, longitude double", delay, ["ts", "late", "event_id", "latitude", "longitude"])
    return found.select("capture.*", "fix_ts", "latitude", "longitude")
