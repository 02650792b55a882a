"""Queries that write tables to the shared folder with the library's writers and read them back with its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafspark.functions import scalars
from leafspark.plans.catalog_records import DOCS, docs
from leafspark.plans.registry import query, r6
from leafspark.session import work_folder
from leafspark.sources import documents, files


def fresh(v) -> str:
    return f"{work_folder(v.spark)}/files-{uuid.uuid4().hex}"


SCANNED = ' select "type", hue, ' + r6("shape_index") + " shape_index from factors"


@query("src1_read_factor_csv", "factors", SCANNED)
def _(v):
    folder = fresh(v)
    v.factors.write.option("header", True).csv(folder)
    return files.read_factors(v.spark, folder, ["hue", "shape_index"])


@query("src1_read_factor_parquet", "factors", SCANNED)
def _(v):
    folder = fresh(v)
    v.factors.write.parquet(folder)
    return files.read_factors(v.spark, folder, ["hue", "shape_index"], "parquet")


@query("src4_append_numbered", "factors", """ select name, hue, row_number() over (order by image_id%2, image_id, old, name, hue)-1 "number" from (select *, number old from factors)""")
def _(v):
    """Two appends: the second goes on with the numbers of the first."""
    folder = fresh(v)
    for part in (0, 1):
        rows = v.factors.filter(F.col("image_id") % 2 == part).withColumn("old", F.col("number"))
        files.append_factors(rows, f"{folder}/scalars", f"{folder}/vectors", ["image_id", "old", "name", "hue"])
    return v.spark.read.parquet(f"{folder}/scalars").select("name", "hue", "number")


@query("src7_image_by_hash", "images", " select image_id, hash from images where hash=(select min(hash) from (select hash from images group by hash having count(*)=1))")
def _(v):
    known = v.images.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").agg(F.min("hash")).first()[0]
    return documents.find_image_by_hash(v.images, known).select("image_id", "hash")


@query("src9_upsert_images", "images", DOCS + """, u as (select parent, max(blob) b, count(*) n from docs group by parent)
 select image_id, crop, case when parent is null then 'ndi=first' when image_id%3=0 then 'exg=u'||b||',ndi=first' else 'ndi=u'||b end processed,
 case when parent is null or image_id%2=0 then 'otsu=old' else 'otsu=old,triangle=s'||n end segmented from images left join u on parent=image_id""")
def _(v):
    """Stored images, then updates of both maps for those that have blobs, then the latest version."""
    folder = fresh(v)
    entry = lambda key, value: F.create_map(F.lit(key), value)
    stored = v.images.select("image_id", "crop", entry("ndi", F.lit("first")).alias("processed"), entry("otsu", F.lit("old")).alias("segmented"))
    documents.upsert_stored(folder, stored)
    last = docs(v).groupBy("parent").agg(F.max("blob").alias("b"), F.count(F.lit(1)).alias("n"))
    url = F.concat(F.lit("u"), F.col("b").cast("string"))
    updates = last.join(v.images.select("image_id"), F.col("parent") == F.col("image_id")).select(
        "image_id", F.when(F.col("image_id") % 3 == 0, entry("exg", url)).otherwise(entry("ndi", url)).alias("processed"),
        F.when(F.col("image_id") % 2 == 1, entry("triangle", F.concat(F.lit("s"), F.col("n").cast("string")))).alias("segmented"))
    documents.upsert_stored(folder, updates)
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return files.read_version(v.spark, folder).select("image_id", "crop", told("processed").alias("processed"), told("segmented").alias("segmented"))


@query("src11_performance_file", "perf_log", ' select activity, us "microseconds" from perf_log')
def _(v):
    folder = fresh(v)
    for kind in (True, False):
        files.append_performance(v.perf_log.filter((F.col("microseconds") % 2 == 0) == kind), folder)
    return files.read_performance(v.spark, folder)


@query("src16_results_file", "results", " select id, technique, correction, auc, f1, status from results")
def _(v):
    folder = fresh(v)
    files.save_results(v.results, folder)
    return files.load_results(v.spark, folder).select("id", "technique", "correction", "auc", "f1", "status")


@query("src17_organised_file", "images", """, k as (select image_id, crop, (select b from (values (30.0::double,0),(60.0,1),(120.0,2),(400.0,3),(800.0,4)) t(b,i) order by abs(altitude-b), i limit 1) agl from images)
 select image_id, crop, cast(agl as int) agl from k where agl=400 or (agl=800 and crop<>'building') union all select -image_id, crop, 800 from k where agl=800 and crop='building'""")
def _(v):
    """All images written by bucket and crop, one bucket's crop written anew, two buckets read back."""
    folder = fresh(v)
    placed = v.images.select("image_id", "crop", scalars.nearest_bucket(F.col("altitude"), [30, 60, 120, 400, 800]).cast("int").alias("agl"))
    files.organise(placed, folder)
    files.organise(placed.filter("agl = 800 and crop = 'building'").withColumn("image_id", -F.col("image_id")), folder)
    return v.spark.read.parquet(folder).filter("agl in (400, 800)").select("image_id", "crop", "agl")


@query("src19_imu_file", "", f"select {r6('quality*0.5')} x, {r6('toxic*0.25')} y, {r6('doc_id/8.0')} z from labels")
def _(v):
    folder = fresh(v)
    v.table("labels").select((F.col("quality") * 0.5).alias("x"), (F.col("toxic") * 0.25).alias("y"), (F.col("doc_id") / 8).alias("z")).write.option("header", True).csv(folder)
    return files.read_imu_log(v.spark, folder)
