"""Streams of images: every new image becomes factor rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leafspark.plans.flow import image_factors
from leafspark.session import cut_lineage
from leafspark.sources.files import READABLE, append_factors, unpack_images

PACKED = "image_id string, height int, width int, nChannels int, data binary"
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def image_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Packed images from the picture files that appear in a folder; files that are no readable pictures are left out,
    as in the batch reader, whose ``rejected_images`` lists them."""
    raw = (spark.readStream.format("image").schema(IMAGE).option("maxFilesPerTrigger", files_per_trigger).load(folder).filter(READABLE))
    return raw.select(F.col("image.origin").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")


def process_stream(packed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Run a caller-supplied handler on the pixels of each micro-batch. Images of few files are dealt over all cores."""
    def each(batch: DataFrame, batch_id: int) -> None:
        cores = batch.sparkSession.sparkContext.defaultParallelism
        handle(unpack_images(batch.repartition(cores) if batch.rdd.getNumPartitions() < cores else batch), batch_id)
    return packed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def factor_stream(packed: DataFrame, scalar_path: str, vector_path: str, checkpoint: str, min_area: int = 0) -> DataStreamWriter:
    """Append the factors of every image that arrives. Its pixels are unpacked once, for all steps of the flow."""
    def handle(pixels: DataFrame, batch_id: int) -> None:
        append_factors(image_factors(cut_lineage(pixels), min_area=min_area), scalar_path, vector_path)
    return process_stream(packed, handle, checkpoint)
