"""Stored tables that change: numbering across appends, versions, upserts of both maps, buckets written anew."""

import pytest
from pyspark.sql import functions as F

from leafspark.sources import documents, files


def test_numbers_go_on(spark, tmp_path):
    path = (f"{tmp_path}/s", f"{tmp_path}/v")
    for first, n in ((0, 700), (700, 1), (701, 300)):
        rows = spark.range(first, first + n).select(F.col("id").cast("double").alias("hue"), F.format_string("blob%04d", "id").alias("name"), F.lit(99).alias("number"),
                                                    F.array(F.col("id").cast("double")).alias("greyscale_lbp")).repartition(7)
        files.append_factors(rows, *path, order=["name"])
    scalars = {r["name"]: r["number"] for r in spark.read.parquet(path[0]).collect()}
    assert scalars == {f"blob{k:04d}": k for k in range(1001)}
    assert {r["name"]: r["number"] for r in spark.read.parquet(path[1]).collect()} == scalars
    assert files.numbered_on(spark.range(3).withColumn("name", F.col("id").cast("string")), ["name"], f"{tmp_path}/none").agg(F.min("number")).first()[0] == 0


def test_a_failed_version_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert files.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        files.read_version(spark, path)
    assert files.write_version(spark.range(5), path) == 1
    with pytest.raises(Exception):
        files.write_version(spark.range(100, 200).select(F.when(F.col("id") < 190, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("id")), path)
    assert files.read_version(spark, path).count() == 5
    assert files.write_version(files.read_version(spark, path).union(spark.range(2)), path) == 2
    assert files.read_version(spark, path).count() == 7 and files.read_version(spark, path, 1).count() == 5


def test_upsert_of_both_maps(spark, tmp_path):
    kind = "image_id long, crop string, processed map<string,string>, segmented map<string,string>"
    old = spark.createDataFrame([(1, "beet", {"a": "1"}, {"s": "1"}), (2, None, None, {"s": "2"}), (None, "x", {"n": "0"}, None)], kind)
    new = spark.createDataFrame([(1, None, {"b": "2"}, {"s": "9"}), (3, "corn", {"c": "3"}, None), (None, "y", {"n": "1"}, {"q": "1"})], kind)
    want = {1: ("beet", {"a": "1", "b": "2"}, {"s": "9"}), 2: (None, {}, {"s": "2"}), 3: ("corn", {"c": "3"}, {}), None: ("y", {"n": "1"}, {"q": "1"})}
    told = lambda df: {r["image_id"]: (r["crop"], r["processed"], r["segmented"]) for r in df.collect()}
    assert told(documents.upsert_images(old, new)) == want
    documents.upsert_stored(f"{tmp_path}/i", old)
    assert documents.upsert_stored(f"{tmp_path}/i", new) == 2
    assert told(files.read_version(spark, f"{tmp_path}/i")) == want


def test_search_by_hash(spark):
    images = spark.createDataFrame([(1, 7), (2, 8), (3, 8)], "image_id long, hash long")
    assert [r["image_id"] for r in documents.find_image_by_hash(images, 7).collect()] == [1]
    assert documents.find_image_by_hash(images, 99).count() == 0
    with pytest.raises(Exception, match="more than one image"):
        documents.find_image_by_hash(images, 8).collect()


def test_buckets_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([(1, 30, "beet"), (2, 60, "beet"), (3, 30, "corn")], "image_id long, agl int, crop string")
    files.organise(rows, f"{tmp_path}/o")
    files.organise(rows.filter("image_id = 1").withColumn("image_id", F.lit(10).cast("long")), f"{tmp_path}/o")
    assert sorted(r["image_id"] for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [2, 3, 10]
