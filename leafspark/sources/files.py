"""Readers and writers for factor tables, images, logs and results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.functions.catalog_of_factors import scalar_columns, vector_columns
from leafspark.session import cut_lineage

#: The image reader gives unreadable files a height and width of -1 and no data.
READABLE = "image.height > 0 and image.width > 0"
#: Pixels of images that are unpacked together; a larger image is unpacked alone or with the ones after it up to this many.
UNPACKED = 250_000
PIXEL_SCHEMA = "image_id string, x int, y int, r int, g int, b int"


def read_factors(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "csv") -> DataFrame:
    """Named factor columns and the class. Only these columns are read from columnar files."""
    if fmt == "csv":
        df = spark.read.csv(path, header=True)
        return df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("type").cast("int").alias("type"))
    return spark.read.format(fmt).load(path).select(*columns, "type")


def _unpacked(images: pd.DataFrame) -> pd.DataFrame:
    """The pixels of some images, one after the other."""
    sizes, width = (images["height"] * images["width"]).to_numpy(), images["width"].to_numpy()
    data = [np.frombuffer(row.data, dtype=np.uint8).reshape(row.height * row.width, row.nChannels) for row in images.itertuples(index=False)]
    bands = np.concatenate([np.repeat(pixels, 3, axis=1) if pixels.shape[1] == 1 else pixels[:, :3] for pixels in data])
    place, width = np.arange(len(bands)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(width, sizes)
    return pd.DataFrame({"image_id": np.repeat(images["image_id"].to_numpy(), sizes), "x": place % width, "y": place // width,
                         "r": bands[:, 2], "g": bands[:, 1], "b": bands[:, 0]})


def unpack_images(images: DataFrame) -> DataFrame:
    """Pixels of packed images: image_id, height, width, nChannels, data (rows of B, G, R bytes). Small images are unpacked together."""
    def unpack(batches):
        for frame in batches:
            before = (frame["height"] * frame["width"]).cumsum() // UNPACKED
            for _, part in frame.groupby(before.to_numpy()):
                yield _unpacked(part)
    id_type = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "height", "width", "nChannels", "data").mapInPandas(
        unpack, PIXEL_SCHEMA.replace("image_id string", f"image_id {id_type}"))


def pack_images(pixels: DataFrame) -> DataFrame:
    """The reverse of :func:`unpack_images`, for images that fit one row each."""
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "b", "g", "r")))
    hexed = F.transform(ordered, lambda p: F.concat(*[F.lpad(F.hex(p[c].cast("long")), 2, "0") for c in "bgr"]))
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
                                          F.unhex(F.array_join(hexed, "")).alias("data")).withColumn("nChannels", F.lit(3))


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of all image files in a folder that can be read; :func:`rejected_images` lists the others."""
    images = spark.read.format("image").load(folder).filter(READABLE)
    return unpack_images(images.select(F.col("image.origin").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data"))


def rejected_images(spark: SparkSession, folder: str) -> DataFrame:
    """image_id and reason of the files of a folder that are not readable pictures."""
    images = spark.read.format("image").load(folder).filter(f"not ({READABLE})")
    return images.select(F.col("image.origin").alias("image_id"), F.lit("not a readable picture").alias("reason"))


def read_image_meta(table: DataFrame) -> DataFrame:
    """Typed image tags from a table of texts."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return table.select("image_id", number("lat"), number("long"), number("altitude"), number("focal"), "make", "model",
                        F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")).alias("taken"))


def split_factor_kinds(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scalar and vector factor columns that the table has, each with its identifying columns."""
    pick = lambda names: df.select(*[c for c in names if c in df.columns])
    return pick(scalar_columns()), pick(vector_columns())


def append_factors(df: DataFrame, scalar_path: str, vector_path: str, order: Sequence[str] | None = None) -> None:
    """Append scalar and vector factors to their own tables. With an ``order`` (columns that tell rows apart) the rows are
    numbered on from the last number that the scalar table has, and both tables get the same numbers."""
    df = cut_lineage(numbered_on(df, order, scalar_path) if order else df)  # both tables are written from rows that are made once
    scalars, vectors = split_factor_kinds(df)
    vectors.write.mode("append").parquet(vector_path)
    scalars.write.mode("append").parquet(scalar_path)  # last: its numbers say where the next append begins


def numbered_on(df: DataFrame, order: Sequence[str], path: str, start: int = 0) -> DataFrame:
    """df with ``number`` in the order of the columns, going on after the largest number stored under path.

    Rows are dealt in ranges of the order and numbered by counts per range, so no task holds them all.
    """
    spark = df.sparkSession
    last = spark.read.parquet(path).agg(F.max("number")).first()[0] if stored(spark, path) else None
    first = start if last is None else last + 1
    names = [c for c in df.columns if c != "number"]
    ranged = cut_lineage(df.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ranged.withColumn("_k", inside).join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return placed.select(*names, (F.col("_before") + F.col("_k") - 1 + F.lit(first)).alias("number"))


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely under the path."""
    store, where = _path(spark, f"{path}/_SUCCESS")
    return store.exists(where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table kept as version=N folders, oldest first."""
    store, where = _path(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [n for n in found if stored(spark, f"{path}/version={n}")]


def write_version(df: DataFrame, path: str) -> int:
    """Write df as the next version of the table under path; readers see it when it is complete. Its number.

    A try that fails leaves the versions before it as they are, so a table may be read and replaced in one step.
    """
    number = max([0, *versions(df.sparkSession, path)]) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The latest complete version of a table, or the one with a number."""
    known = versions(spark, path)
    if not known or number is not None and number not in known:
        raise FileNotFoundError(f"no such complete version under {path}")
    return spark.read.parquet(f"{path}/version={known[-1] if number is None else number}")


def combine(tables: Sequence[DataFrame]) -> DataFrame:
    """One table from many; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def append_performance(df: DataFrame, path: str) -> None:
    df.select("activity", "microseconds").write.mode("append").parquet(path)


def read_performance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("activity string, microseconds bigint").parquet(path)


def save_results(results: DataFrame, path: str) -> None:
    """Sweep results, one folder per technique and correction."""
    results.write.mode("overwrite").partitionBy("technique", "correction").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def organise(images: DataFrame, path: str) -> None:
    """Images by altitude bucket and crop. Only the buckets and crops that images has are replaced."""
    images.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agl", "crop").parquet(path)


def read_imu_log(spark: SparkSession, path: str) -> DataFrame:
    """Three numbers per line, for gyro or acceleration logs."""
    return spark.read.schema("x double, y double, z double").csv(path, header=True)
