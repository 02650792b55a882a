"""Folds over devices: readings without a device, and captures with the latest position, in batch and as streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafspark.streaming import odometry

START = dt.datetime(2024, 5, 1, 8, 0, 0)
at = lambda s: START + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(2)
    rows = [(device, at(10 * i + k), 100 * i + k, float(rng.randrange(0, 400)), i, rng.uniform(0, 80)) for i in range(40) for k, device in enumerate([1, None, 2**60 + 1])]
    return spark.createDataFrame(rows, "device long, ts timestamp, event_id long, angle double, sequence long, mm double")


def plain_travel(rows):
    out, state = {}, {}
    for device, ts, event_id, angle, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        last, total = state.get(device, (0.0, 0.0))
        state[device] = (angle, total + (angle - last) * 0.5)
        out[device, event_id] = state[device][1]
    return out


def test_readings_without_a_device(spark, readings):
    rows = [tuple(r) for r in readings.collect()]
    got = odometry.travel(readings, 0.5, 1000).collect()
    assert {(r["device"], r["event_id"]): r["total_mm"] for r in got} == pytest.approx(plain_travel(rows)) and len(got) == len(rows)
    seen = odometry.announce(readings, 50.0).collect()
    assert {r["device"] for r in seen} == {1, None, 2**60 + 1}
    since, want = {}, []
    for device, ts, event_id, _, _, mm in sorted(rows, key=lambda r: (r[1], r[2])):
        since[device] = since.get(device, 0.0) + mm
        if since[device] >= 50:
            want.append((device, event_id))
            since[device] = 0.0
    assert sorted(map(str, want)) == sorted(str((r["device"], r["event_id"])) for r in seen)
    messages = readings.withColumns({"total_mm": F.col("event_id").cast("double"), "latitude": F.lit(1.0), "longitude": F.lit(2.0), "kph": F.lit(3.0)})
    taken = odometry.captures(messages, {"color": 40.0}).collect()
    by = {d: sum(r["device"] == d for r in taken) for d in (1, None, 2**60 + 1)}
    assert by[1] == by[None] == by[2**60 + 1] > 20


CAPTURES = [(1, 5, 1, "a"), (1, 20, 2, "b"), (1, 200, 3, "c"), (2, 30, 4, "d"), (None, 12, 5, "e"), (1, 40, 6, "f"), (3, 9, 7, "g"), (1, 40, 8, "h")]
FIXES = [(1, 1, 10.0, 20.0), (1, 3, 11.0, 21.0), (1, 20, 12.0, 22.0), (1, 41, 13.0, 23.0), (None, 2, 14.0, 24.0), (2, 31, 15.0, 25.0), (1, 100, 16.0, 26.0)]


def wanted(within):
    out = {}
    for device, s, event_id, _ in CAPTURES:
        fix = max([f for f in FIXES if f[0] == device and f[1] <= s], key=lambda f: f[1], default=None)
        out[event_id] = fix[1:] if fix and s - fix[1] <= within else (None, None, None)
    return out


def frames(spark):
    captured = spark.createDataFrame([(d, at(s), e, n) for d, s, e, n in CAPTURES], "device long, ts timestamp, event_id long, camera string")
    fixes = spark.createDataFrame([(d, at(s), a, o) for d, s, a, o in FIXES], "device long, fix_ts timestamp, latitude double, longitude double")
    return captured, fixes


def told(rows):
    return {r["event_id"]: (r["fix_ts"] and (r["fix_ts"] - START).total_seconds(), r["latitude"], r["longitude"]) for r in rows}


@pytest.mark.parametrize("within", [60, 15])
def test_latest_position(spark, within):
    captured, fixes = frames(spark)
    rows = odometry.latest_position(captured, fixes, within).collect()
    assert len(rows) == len(CAPTURES) and told(rows) == wanted(within)
    assert {(r["device"], r["event_id"], r["camera"], r["ts"]) for r in rows} == {(d, e, n, at(s)) for d, s, e, n in CAPTURES}
    assert odometry.latest_position(captured.limit(0), fixes, within).count() == 0


def test_latest_position_stream_out_of_order(spark, tmp_path):
    """Two batches, each with events of all times; a fix of the second batch still reaches the captures of the first."""
    captured, fixes = frames(spark)
    ends = spark.createDataFrame([(d, at(100_000), 99, "end") for d in (1, 2, 3, None)], captured.schema)
    for k in range(2):
        captured.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
        fixes.filter(F.col("latitude") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    ends.coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
    read = lambda df, name: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    stream = odometry.latest_position(read(captured, "c"), read(fixes, "f"), 60, "1 hour")
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = [r for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect() if r["event_id"] != 99]
    assert len(rows) == len(CAPTURES) and told(rows) == wanted(60)
