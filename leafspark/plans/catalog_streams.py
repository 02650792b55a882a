"""Queries that run streams to the end of their input, and the batch twins of the stateful operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.functions import rules
from leafspark.operators import odometry as scans
from leafspark.plans import flow
from leafspark.plans.catalog_records import SQ, TR
from leafspark.plans.registry import query, r6
from leafspark.plans.views import Views
from leafspark.session import cut_lineage, ensure_checkpoint_dir
from leafspark.sources import files, messages
from leafspark.streaming import images, odometry

GSD = {"color": 40.0, "depth": 90.0}


def work_folder(spark) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(v: Views) -> DataFrame:
    """The events table as a stream of encoder readings."""
    raw = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return raw.select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"),
                      F.floor(F.col("value") * 10).cast("double").alias("angle"), (F.floor(F.col("event_id") / 100) - 1).alias("sequence"))


def drained(v: Views, stream: DataFrame) -> DataFrame:
    """Run a stream over all input that is there and read what it wrote."""
    folder = work_folder(v.spark)
    run = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def feed(df: DataFrame, time: str, files: int = 4) -> str:
    """Write df as files that follow each other in time, so that a stream takes them in as many micro-batches.

    df is computed once, on all cores; only the files are written by one task each.
    """
    folder, df = work_folder(df.sparkSession), cut_lineage(df)
    bounds = df.agg(F.percentile_approx(F.unix_micros(time), [i / files for i in range(1, files)])).first()[0] or []
    part = sum([(F.unix_micros(time) > b).cast("int") for b in sorted(set(bounds))], F.lit(0))
    for i in range(len(set(bounds)) + 1):
        df.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def odometer_messages(v: Views) -> DataFrame:
    t = scans.travel(v.odometry, 0.5, 1000)
    return t.select("device", "ts", "event_id", "sequence", "total_mm", "kph", (32 + F.col("event_id") % 977 / 1000.0).alias("latitude"),
                    (-110 + F.col("event_id") % 523 / 1000.0).alias("longitude"))


query("str1_travel_stream", "odometry", TR + f" select event_id, {r6('mm')} mm, {r6('kph')} kph, {r6('total_mm')} total_mm, {r6('pulses')} pulses from tr")(
    lambda v: drained(v, odometry.travel(event_stream(v), 0.5, 1000, delay="0 seconds")).select("event_id", "mm", "kph", "total_mm", "pulses"))

ANNOUNCE = TR + """, nr as materialized (select *, row_number() over (partition by device order by ts, event_id) n from tr),
 an(device, n, event_id, total_mm, moved, since) as (select device, n, event_id, total_mm, mm, case when abs(mm)>=100 then 0.0 else mm end from nr where n=1
 union all select nr.device, nr.n, nr.event_id, nr.total_mm, an.since+nr.mm, case when abs(an.since+nr.mm)>=100 then 0.0 else an.since+nr.mm end from an join nr on nr.device=an.device and nr.n=an.n+1)"""
ANNOUNCED = ANNOUNCE + f" select event_id, {r6('moved')} distance, {r6('total_mm')} total_mm, row_number() over (partition by device order by n) as \"sequence\" from an where abs(moved)>=100"
query("str2_announce", "odometry", ANNOUNCED)(
    lambda v: odometry.announce(scans.travel(v.odometry, 0.5, 1000), 100.0).select("event_id", "distance", "total_mm", "sequence"))
query("str2_announce_stream", "odometry", ANNOUNCED)(
    lambda v: drained(v, odometry.announce(event_moves(v), 100.0, delay="0 seconds")).select("event_id", "distance", "total_mm", "sequence"))


def event_moves(v):
    """Moves as a stream: the travel fold has run before, as on the device that sends them."""
    moves = odometry.travel(v.odometry, 0.5, 1000).select("device", "ts", "event_id", "mm")
    folder = feed(moves, "ts")
    return v.spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(folder)


CAPTURE = TR + SQ + """, ms as materialized (select sq.device, sq.event_id, sq.ts, sq.state, tr.total_mm, tr.kph, row_number() over (partition by sq.device order by sq.ts, sq.event_id) n
 from sq join tr on sq.event_id=tr.event_id where state in ('ok','gap')),
 cm as (select * from (values ('color',40.0::double),('depth',90.0)) t(camera,gsd)),
 cp(camera, gsd, device, n, event_id, kph, moved, hit, alert, last) as (
 select camera, gsd, device, n, event_id, kph, total_mm, total_mm>gsd, false, case when total_mm>gsd then total_mm else 0.0::double end from ms, cm where n=1
 union all select cp.camera, cp.gsd, ms.device, ms.n, ms.event_id, ms.kph, ms.total_mm-cp.last, ms.total_mm-cp.last>cp.gsd, ms.state='gap' and ms.total_mm-cp.last>cp.gsd*1.2,
 case when ms.total_mm-cp.last>cp.gsd then ms.total_mm else cp.last end from cp join ms on ms.device=cp.device and ms.n=cp.n+1)"""
CAPTURED = CAPTURE + f" select event_id, camera, 'capture' kind, {r6('moved')} movement, {r6('kph')} kph from cp where hit union all select event_id, camera, 'alert', {r6('moved')}, {r6('kph')} from cp where alert"
query("str4_capture", "odometry", CAPTURED)(
    lambda v: odometry.captures(odometer_messages(v), GSD).select("event_id", "camera", "kind", "movement", "kph"))
query("str4_capture_stream", "odometry", CAPTURED)(lambda v: capture_stream(v).select("event_id", "camera", "kind", "movement", "kph"))


def capture_stream(v):
    """JSON messages written as a feed, parsed again as a stream, then the capture fold."""
    source = odometer_messages(v).withColumns({"total_distance": F.col("total_mm"), "speed": F.col("kph")})
    source = source.withColumn("timestamp", F.unix_micros("ts") * 1000)
    formed = messages.form(source, "odometry").select("device", "event_id", "value", F.col("ts").alias("sent"))
    folder = feed(formed, "sent")
    raw = v.spark.readStream.schema("device bigint, event_id bigint, value string").option("maxFilesPerTrigger", 1).parquet(folder)
    parsed = messages.parse(raw, "odometry")
    fields = parsed.select("device", "event_id", messages.event_time(F.col("timestamp")).alias("ts"), "sequence", F.col("total_distance").alias("total_mm"),
                           "latitude", "longitude", F.col("speed").alias("kph"))
    return drained(v, odometry.captures(fields, GSD, delay="0 seconds"))


query("str6_fresh_stream", "odometry", " select event_id, kind from odometry where event_id%11<5")(
    lambda v: drained(v, odometry.fresh_only(event_stream(v).withColumn(
        "received", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 11 * 1000000)))).select("event_id", "kind"))
query("str7_captures_with_position", "odometry", CAPTURE + f""" select event_id, camera, {r6('32+(event_id%977)/1000.0')} latitude, {r6('-110+(event_id%523)/1000.0')} longitude, {r6('kph')} kph from cp where hit""")(
    lambda v: capture_stream(v).filter("kind = 'capture'").select("event_id", "camera", "latitude", "longitude", "kph"))
query("str7_position_join", "odometry", """ select o.event_id, g.event_id fix_id from odometry o join odometry g on o.device=g.device and o.kind='click' and g.kind='view'
 and g.ts<=o.ts and g.ts>=o.ts-interval 1 hour""")(
    lambda v: drained(v, odometry.attach_position(
        event_stream(v).filter("kind = 'click'").select("device", "ts", "event_id"),
        event_stream(v).filter("kind = 'view'").select("device", F.col("ts").alias("fix_ts"), F.col("event_id").cast("double").alias("latitude"), F.lit(0.0).alias("longitude")),
        "1 hour", "2 hours")).select("event_id", F.col("latitude").cast("long").alias("fix_id")))
LATEST = """ select event_id, coalesce(fix_id, -1) fix_id from (select o.event_id, g.event_id fix_id, row_number() over (partition by o.event_id order by g.ts desc nulls last, g.event_id desc) k from odometry o left join odometry g
 on o.device=g.device and g.kind='view' and g.ts<=o.ts and g.ts>=o.ts-interval 1 hour where o.kind='click') where k=1"""



def latest_fixes(v, readings):
    captured = readings().filter("kind = 'click'").select("device", "ts", "event_id")
    fixes = readings().filter("kind = 'view'").select("device", F.col("ts").alias("fix_ts"), F.col("event_id").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"))
    return odometry.latest_position(captured, fixes, 3600.0, "0 seconds")


query("str7_latest_position", "odometry", LATEST)(lambda v: latest_fixes(v, lambda: v.odometry).selectExpr("event_id", "coalesce(cast(latitude as bigint), -1) AS fix_id"))
query("str7_latest_position_stream", "odometry", LATEST)(
    lambda v: drained(v, latest_fixes(v, lambda: event_stream(v))).selectExpr("event_id", "coalesce(cast(latitude as bigint), -1) AS fix_id"))
query("str8_count_stream", "odometry", """, w as (select date_trunc('hour', ts) s, kind, count(*) n from odometry group by all)
 select strftime(s,'%Y-%m-%d %H:%M:%S') "start", kind, n from w where s+interval 1 hour<=(select max(ts) from odometry)-interval 10 minute""")(lambda v: drained(v, odometry.count_messages(event_stream(v))).withColumn("start", F.col("start").cast("string")))
query("str3_distinct_stream", "odometry", ' select distinct device, "sequence" from odometry')(
    lambda v: drained(v, odometry.first_of_sequence(event_stream(v), "60 days")).select("device", "sequence"))


def packed_stream(v):
    folder = work_folder(v.spark)
    packed = files.pack_images(v.pixels).withColumn("image_id", F.col("image_id").cast("string"))
    packed.select("image_id", "height", "width", "nChannels", "data").write.parquet(folder)
    return v.spark.readStream.schema(images.PACKED).option("maxFilesPerTrigger", 1000).parquet(folder)


@query("str10_image_stream")
def _(v):
    folder = work_folder(v.spark)
    run = images.factor_stream(packed_stream(v), f"{folder}/scalars", f"{folder}/vectors", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return v.spark.read.parquet(f"{folder}/scalars")


query("udf2_image_callback", "pixels", f" select cast(image_id as varchar) image_id, {r6('avg(case when 2*g-r-b>50 then 1.0 else 0.0 end)')} green from pixels group by image_id")(
    lambda v: image_callback(v))


def image_callback(v):
    """A caller's own step on every micro-batch of images."""
    folder = work_folder(v.spark)

    def green_share(pixels, batch_id):
        pixels.groupBy("image_id").agg(F.avg(rules.threshold_mask(F.col("g") * 2 - F.col("r") - F.col("b"), 50)).alias("green")).write.mode("append").parquet(f"{folder}/out")

    images.process_stream(packed_stream(v), green_share, f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{folder}/out")


query("flow_image_factors", "pixels")(lambda v: flow.image_factors(v.pixels).drop("greyscale_lbp"))
