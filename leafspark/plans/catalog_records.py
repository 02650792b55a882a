"""Queries over documents, messages, names and odometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import catalog_of_factors, rules, scalars
from leafspark.operators import odometry
from leafspark.operators.grouped import ordered_scan, ranged
from leafspark.plans.registry import query, r6
from leafspark.plans.views import TECHNIQUES, _list_sql
from leafspark.sources import documents, files, messages


def text(column, pattern="yyyy-MM-dd HH:mm:ss"):
    return F.date_format(column, pattern)


def docs(v):
    """Blob documents: parent, blob, technique, type, hash, factors map."""
    t = v.table("lineitem")
    return t.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("blob"),
                    F.element_at(F.array(*[F.lit(x) for x in TECHNIQUES]), F.col("l_linenumber")).alias("technique"),
                    F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("type"), (F.col("l_suppkey") * 10).cast("double").alias("altitude"),
                    F.create_map(F.lit("hue"), F.col("l_quantity"), F.lit("saturation_mean"), F.col("l_discount")).alias("factors"))


DOCS = f""", docs as (select l_orderkey parent, l_partkey blob, {_list_sql(TECHNIQUES)}[l_linenumber] technique,
 case when l_returnflag='R' then 1 else 0 end "type", cast(l_suppkey*10 as double) altitude, l_quantity hue, l_discount saturation_mean from lineitem)"""

query("src2_unpack_pixels", "pixels", " select * from pixels")(lambda v: files.unpack_images(files.pack_images(v.pixels)))
query("src3_image_meta", "images", f""" select image_id, {r6('lat')} lat, {r6('long')} as "long", altitude, 8.0::double focal, 'DJI' make, 'FC3411' model,
 strftime(acquired,'%Y-%m-%d %H:%M:%S') taken from images""")(
    lambda v: files.read_image_meta(v.images.select(
        "image_id", F.col("lat").cast("string").alias("lat"), F.col("long").cast("string").alias("long"), F.col("altitude").cast("string").alias("altitude"),
        F.lit("8.0").alias("focal"), F.lit("DJI").alias("make"), F.lit("FC3411").alias("model"),
        text(F.col("acquired"), "yyyy:MM:dd HH:mm:ss").alias("taken"))).withColumn("taken", text(F.col("taken"))))
query("src4_split_kinds", "factors", f" select hue, saturation_mean, in_phase, {r6('shape_index')} shape_index, compactness, name, number, \"type\" from factors")(
    lambda v: files.split_factor_kinds(v.factors)[0])
query("src5_combine", "factors", " select name, hue, null::double as agl from factors union all select name, null, in_phase from factors")(
    lambda v: files.combine([v.factors.select("name", "hue"), v.factors.select("name", F.col("in_phase").alias("agl"))]))
query("src6_find_images", "images", " select image_id, crop, altitude from images where crop='machinery' and altitude between 100 and 700 and acquired between timestamp '1996-01-01' and timestamp '1999-12-31'")(
    lambda v: documents.find_images(v.images, "machinery", 100, 700, "1996-01-01", "1999-12-31").select("image_id", "crop", "altitude"))
query("src7_duplicate_hashes", "images", " select hash, count(*) n from images group by hash having count(*)>1")(
    lambda v: documents.duplicate_hashes(v.images))
query("src8_find_blobs", "images", DOCS + " select parent, blob, technique from docs where altitude=500")(
    lambda v: documents.find_blobs(docs(v), altitude=500.0).select("parent", "blob", "technique"))


@query("src9_merge_urls", "images", DOCS + """, u as (select parent, technique, arg_max('image://p/'||blob, strftime(l_shipdate,'%Y%m%d')||lpad(blob::varchar,12,'0')) url from
 (select l_orderkey parent, l_partkey blob, """ + f"{_list_sql(TECHNIQUES)}[l_linenumber]" + """ technique, l_shipdate from lineitem) group by all)
 select parent image_id, count(*) n, string_agg(technique||'='||url, ',' order by technique) urls from u group by parent""")
def _(v):
    t = v.table("lineitem")
    updates = t.select(F.col("l_orderkey").alias("image_id"), F.element_at(F.array(*[F.lit(x) for x in TECHNIQUES]), F.col("l_linenumber")).alias("technique"),
                       F.concat(F.lit("image://p/"), F.col("l_partkey").cast("string")).alias("url"), "l_shipdate", "l_partkey")
    merged = documents.merge_urls(updates, ["l_shipdate", "l_partkey"])
    pairs = F.transform(F.array_sort(F.map_entries("processed")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("image_id", F.size("processed").cast("long").alias("n"), F.array_join(pairs, ",").alias("urls"))


query("src10_training_set", "images", DOCS + """ select name||'-blob'||blob as "name", hue, saturation_mean, "type" from docs join images on parent=image_id
 where crop='furniture' and images.altitude between 0 and 900 and technique='KNN'""")(
    lambda v: documents.training_set(documents.find_images(v.images, "furniture"), docs(v).filter("technique = 'KNN'"), ["hue", "saturation_mean"]))
query("src11_performance", "perf_log", ' select activity, us "microseconds" from perf_log')(lambda v: v.perf_log)


@query("src12_odometry_json", "odometry", """ select event_id, 'DISTANCE' "type", angle distance, 0.0::double speed, 'odometer' source, '' "action", event_id "sequence" from odometry""")
def _(v):
    o = v.odometry.select("event_id", F.lit("DISTANCE").alias("type"), F.lit("odometer").alias("source"), F.col("angle").alias("distance"), F.col("event_id").alias("sequence"))
    raw = messages.form(o, "odometry").select("event_id", "value")
    return messages.parse(raw, "odometry").select("event_id", "type", "distance", "speed", "source", "action", "sequence")


@query("src13_treatment_json", "blobs", """ select blob_id, image_id, 'plan-'||image_id plan, cast(x%4 as int) number, cast(h as double) pulse_start, 0.0::double pulse_stop, '' tier from blobs""")
def _(v):
    b = v.blobs.select("blob_id", "image_id", F.concat(F.lit("plan-"), F.col("image_id").cast("string")).alias("plan"),
                       (F.col("x") % 4).alias("number"), F.col("h").cast("double").alias("pulse_start"))
    raw = messages.form(b, "treatment").select("blob_id", "image_id", "value")
    return messages.parse(raw, "treatment").select("blob_id", "image_id", "plan", "number", "pulse_start", "pulse_stop", "tier")


@query("src14_system_json", "odometry", """ select event_id, kind as "action", '' as "operation", 'OK' "status-camera", '' "status-gps", 12.5::double "param-gsd" from odometry""")
def _(v):
    o = v.odometry.select("event_id", F.col("kind").alias("action"), F.lit("OK").alias("status-camera"), F.lit(12.5).alias("param-gsd"))
    raw = messages.form(o, "system").select("event_id", "value")
    return messages.parse(raw, "system").select("event_id", "action", "operation", "status-camera", "status-gps", "param-gsd")


query("src15_targets", "blobs", """ select image_id, x, y, cast(w as double) distance from blobs""")(
    lambda v: messages.decode_targets(messages.encode_targets(v.blobs.select("image_id", "x", "y", F.col("w").cast("double").alias("distance")), ["image_id"])).drop("part"))
query("src17_organise", "images", """, k as (select crop, list_sort([[abs(altitude-b), i, b] for b, i in [30,60,120,400,800]])[1][3] agl from images)
 select crop, agl, count(*) n from k group by all""".replace("list_sort([[abs(altitude-b), i, b] for b, i in [30,60,120,400,800]])[1][3]",
 "(select b from (values (30.0::double,0),(60.0,1),(120.0,2),(400.0,3),(800.0,4)) t(b,i) order by abs(altitude-b), i limit 1)"))(
    lambda v: v.images.select("crop", scalars.nearest_bucket(F.col("altitude"), [30, 60, 120, 400, 800]).alias("agl"))
    .groupBy("crop", "agl").agg(F.count(F.lit(1)).alias("n")))
FIX = ", fx as (select name, max(number%4) val from factors where hue>45 group by name), rv as (select factors.name, hue, coalesce(val,\"type\") t from factors left join fx on factors.name=fx.name)"


def reviewed(v):
    fixes = v.factors.filter("hue > 45").select("name", (F.col("number") % 4).alias("value"))
    return documents.apply_review(v.factors.drop("actual"), fixes)


query("jn7_review", "factors", FIX + ' select name, hue, t "type", t actual from rv')(lambda v: reviewed(v).select("name", "hue", "type", "actual"))
query("src18_reviewed_split", "factors", FIX + " select name, hue, t actual, t=3 discarded from rv where t in (0,1,3)")(
    lambda v: documents.split_reviewed(reviewed(v))[0].select("name", "hue", "actual", F.lit(False).alias("discarded"))
    .unionByName(documents.split_reviewed(reviewed(v))[1].select("name", "hue", "actual", F.lit(True).alias("discarded"))))
query("src19_imu_scan", "", f"select doc_id, {r6('quality*0.5')} x, {r6('toxic*0.25')} y, {r6('doc_id/8.0')} z from labels")(
    lambda v: v.table("labels").select("doc_id", F.from_csv(F.concat_ws(",", (F.col("quality") * 0.5).cast("string"), (F.col("toxic") * 0.25).cast("string"),
              (F.col("doc_id") / 8).cast("string")), "x double, y double, z double").alias("m")).select("doc_id", "m.*"))
query("jn1_image_blob", "images", DOCS + " select crop, technique, count(*) n, " + r6("avg(hue)") + " hue from docs join images on parent=image_id group by all")(
    lambda v: v.images.join(docs(v), F.col("image_id") == F.col("parent")).groupBy("crop", "technique").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("factors")["hue"]).alias("hue")))
query("jn10_pixel_size", "images", """ select image_id, case when image_id%3=0 then 2.44 when image_id%3=1 then 2.4 else 0.0 end::double pixel_size from images""")(
    lambda v: v.images.select("image_id", scalars.pixel_size(
        F.element_at(F.array(F.lit("iPhone 14 Pro"), F.lit("FC3411"), F.lit("other")), (F.col("image_id") % 3 + 1).cast("int")),
        F.element_at(F.array(F.lit(4032 * 3024), F.lit(5464 * 3640), F.lit(1)), (F.col("image_id") % 3 + 1).cast("int"))).alias("pixel_size")))


def shots(v):
    d = v.table("documents")
    return d.select(F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file")).unionByName(
        d.filter("n_chars % 3 = 0").select(F.concat(F.lit("IMG"), F.col("doc_id").cast("string"), F.lit(".DNG")).alias("file")))


query("jn12_siblings", "", "select 'img'||doc_id||'.jpg' file, n_chars%3=0 remove from documents")(
    lambda v: documents.with_sibling(shots(v), "jpg", "dng").withColumn("remove", F.lit(True)).unionByName(
        documents.with_sibling(shots(v), "jpg", "dng", keep=True).withColumn("remove", F.lit(False))))
query("jn14_pair_masks", "", "select 'img'||doc_id||'-mask-'||lang||'.jpg' mask, 'img'||doc_id stem, lang technique, 'img'||doc_id||'-mask.jpg' reference from documents where n_chars%2=0")(
    lambda v: documents.pair_masks(
        v.table("documents").select(F.format_string("img%d-mask-%s.jpg", "doc_id", "lang").alias("file")),
        v.table("documents").filter("n_chars % 2 = 0").select(F.format_string("img%d-mask.jpg", "doc_id").alias("file"))))
query("set1_union_dates", "season", ' select "type", count(*) n, ' + r6("sum(hue)", 4) + ' hue from season group by "type"', places=4)(
    lambda v: files.combine([v.season.filter(F.year("date") % 2 == odd) for odd in (0, 1)]).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hue").alias("hue")))

# Scalars.
query("scl1_to_dms", "images", f""" select image_id, lat<0 neg, floor(abs(lat)) d, floor((abs(lat)-floor(abs(lat)))*60) m,
 {r6('((abs(lat)-floor(abs(lat)))*60-floor((abs(lat)-floor(abs(lat)))*60))*60')} s from images""")(
    lambda v: v.images.select("image_id", *[c.alias(n) for n, c in scalars.to_dms(F.col("lat")).items()]))
DMS = "(image_id%90+(image_id%60)/60.0+(image_id%3600)/100.0/3600)"
query("scl2_from_dms", "images", f""" select image_id, {r6(f"case when image_id%4 in (2,3) then -{DMS} else {DMS} end")} degrees,
 {r6(f"case when image_id%4 in (1,2) then -{DMS} else {DMS} end")} degrees_compat from images""")(
    lambda v: v.images.select("image_id", *[scalars.from_dms(
        F.col("image_id") % 90, F.col("image_id") % 60, (F.col("image_id") % 3600) / 100.0,
        F.element_at(F.array(*[F.lit(x) for x in "NESW"]), (F.col("image_id") % 4 + 1).cast("int")), compat).alias(name)
        for name, compat in (("degrees", False), ("degrees_compat", True))]))
query("scl3_agl", "images", f" select image_id, {r6('altitude-123.5')} agl from images")(
    lambda v: v.images.select("image_id", scalars.agl(F.col("altitude"), 123.5).alias("agl")))
query("scl4_nearest_agl", "images", """ select image_id, (select b from (values (10.0::double,0),(50.0,1),(200.0,2),(600.0,3)) t(b,i) order by abs(altitude-b), i limit 1) agl,
 case when abs(600-altitude)<(case when abs(200-altitude)<(case when abs(50-altitude)<(case when abs(10-altitude)<10 then 10.0 else 10.0 end) then 50.0 else 10.0 end) then 200.0
 else (case when abs(50-altitude)<10 then 50.0 else 10.0 end) end) then 600.0 else (case when abs(200-altitude)<(case when abs(50-altitude)<10 then 50.0 else 10.0 end) then 200.0
 else (case when abs(50-altitude)<10 then 50.0 else 10.0 end) end) end::double agl_compat from images""")(
    lambda v: v.images.select("image_id", scalars.nearest_bucket(F.col("altitude"), [10, 50, 200, 600]).alias("agl"),
                              scalars.nearest_bucket(F.col("altitude"), [10, 50, 200, 600], compat=True).alias("agl_compat")))
query("scl5_flight_height", "blobs", f""" select image_id, blob_id, {r6('degrees(atan(w*2.4/1000/2/8.0))')} angle, {r6('177.8/2/(w*2.4/1000/2/8.0)')} height from blobs""")(
    lambda v: v.blobs.select("image_id", "blob_id", *[c.alias(n) for n, c in scalars.flight_height(F.col("w"), F.lit(2.4), F.lit(8.0), 177.8).items()]))
query("scl10_trim", "", "select p_partkey, p_name from part")(
    lambda v: v.table("part").select("p_partkey", F.trim(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("p_name")))
query("scl11_content_hash", "", "select doc_id, sha1(text) hash from documents")(
    lambda v: v.table("documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("hash")))
query("scl13_emitter_line", "blobs", """ select blob_id, image_id, case when x%4+1<=4 and y%4+1<=3 then 'line'||((x%4)*3+y%4+case when w%2=0 then 0 else 12 end) end line,
 'port'||(x%8) port from blobs""")(
    lambda v: v.blobs.select("blob_id", "image_id", scalars.emitter_line(
        F.when(F.col("w") % 2 == 0, "LEFT").otherwise("RIGHT"), F.col("x") % 4 + 1, F.col("y") % 4 + 1).alias("line"),
        scalars.line_parts(F.format_string("Mod%d/port%d/line0", "y", F.col("x") % 8))["port"].alias("port")))
query("scl14_magnitude", "", "select l_orderkey, l_partkey, case when l_extendedprice<>0 then cast(floor(log10(abs(l_extendedprice))) as int) end magnitude from lineitem")(
    lambda v: v.table("lineitem").select("l_orderkey", "l_partkey", scalars.magnitude(F.col("l_extendedprice")).alias("magnitude")))
query("agg19_altitude_deviation", "images", f" select crop, {r6('stddev_samp(altitude)')} deviation from images group by crop")(
    lambda v: v.images.groupBy("crop").agg(F.stddev_samp("altitude").alias("deviation")))
query("flt16_fresh", "odometry", " select event_id, event_id%11<5 fresh from odometry")(
    lambda v: v.odometry.select("event_id", rules.is_fresh(F.col("ts"), F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 11 * 1000000)).alias("fresh")))
query("win3_renumber", "factors", """, n as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) number from lineitem) select * from n""")(
    lambda v: renumber(v.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))


def renumber(df):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ordered_scan(ranged(df, [], order), [], order, F.col("__range"), rank="number").drop("__range")


# Odometry.
TR = """, t0 as (select *, angle-coalesce(lag(angle) over w,0.0) change, epoch_us(ts)-epoch_us(lag(ts) over w) us from odometry window w as (partition by device order by ts, event_id)),
 tr as (select *, change*0.5 mm, us/1e6 elapsed, case when us is null or us=0 then 0.0 else (change*0.5/1e6)/((us/1e6)/3600) end kph,
 sum(change*0.5) over w total_mm, sum(change*(360/1000.0)) over w pulses from t0 window w as (partition by device order by ts, event_id))"""
query("win1_travel", "odometry", TR + f" select event_id, {r6('mm')} mm, {r6('elapsed')} elapsed, {r6('kph', 6)} kph from tr")(
    lambda v: odometry.travel(v.odometry, 0.5, 1000).select("event_id", "mm", "elapsed", "kph"))
query("win2_running_totals", "odometry", TR + f" select event_id, {r6('total_mm')} total_mm, {r6('pulses')} pulses from tr")(
    lambda v: odometry.travel(v.odometry, 0.5, 1000).select("event_id", "total_mm", "pulses"))
SQ = """, s0 as (select *, lag("sequence") over (partition by device order by ts, event_id) ls from odometry),
 s1 as (select *, coalesce(case when ls=-1 then 0 else ls end,-1) cur from s0), sq as (select *, case when "sequence"=-1 then 'reset' when "sequence"=cur then 'duplicate'
 when "sequence"<>cur+1 then 'gap' else 'ok' end state from s1)"""
query("str3_sequence_check", "odometry", SQ + """ select event_id, state, case when state='gap' then "sequence"-(cur+1) else 0 end gap from sq""")(
    lambda v: odometry.check_sequence(v.odometry).select("event_id", "state", "gap"))
query("str5_missed_movement", "odometry", TR + SQ + f""", mv as (select sq.event_id, state, total_mm-coalesce(lag(total_mm) over (partition by sq.device order by sq.ts, sq.event_id),0.0) mv
 from sq join tr on sq.event_id=tr.event_id) select event_id, {r6('mv')} movement from mv where state='gap' and mv>20*1.2""")(
    lambda v: odometry.missed_movement(odometry.check_sequence(odometry.travel(v.odometry, 0.5, 1000)), 20.0).select("event_id", "movement"))
query("str9_angle_filter", "odometry", """, nz as (select *, lag(angle) over (partition by device order by ts, event_id) la from odometry where angle<>0)
 select event_id, angle from nz where la is null or la<>angle""")(
    lambda v: odometry.moved_angles(v.odometry).select("event_id", "angle"))
query("win6_fix_distance", "odometry", f""", fx as (select *, 32+(event_id%977)/1000.0 lat, -110+(event_id%523)/1000.0 lon from odometry where kind='view'),
 fl as (select *, lag(lat) over w la, lag(lon) over w lo from fx window w as (partition by device order by ts, event_id))
 select event_id, {r6('2*6371008.8*asin(sqrt(least(pow(sin(radians(lat-la)/2),2)+cos(radians(la))*cos(radians(lat))*pow(sin(radians(lon-lo)/2),2),1.0)))', 4)} metres from fl where la is not null""", places=4)(
    lambda v: odometry.fix_distances(v.odometry.filter("kind = 'view'").withColumns(
        {"lat": 32 + (F.col("event_id") % 977) / 1000.0, "lon": -110 + (F.col("event_id") % 523) / 1000.0})).select("event_id", "metres"))
query("jn11_latest_fix", "odometry", """ select o.event_id, o.angle, g.angle latest_heading from (select * from odometry where kind='click') o
 asof left join (select * from odometry where kind='view') g on o.device=g.device and o.ts>=g.ts""")(
    lambda v: odometry.attach_latest(v.odometry.filter("kind = 'click'").select("device", "ts", "event_id", "angle"),
                                     v.odometry.filter("kind = 'view'").select("device", "ts", "event_id", F.col("angle").alias("heading")), ["heading"])
    .select("event_id", "angle", "latest_heading"))
query("str8_message_counts", "odometry", " select strftime(date_trunc('hour', ts),'%Y-%m-%d %H:%M:%S') \"start\", kind, count(*) n from odometry group by all")(
    lambda v: odometry.counts_by_window(v.odometry).withColumn("start", text(F.col("start"))))
