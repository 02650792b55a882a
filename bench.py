"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR names the folder of parquet files, BENCH_CPUS the number of local cores, BENCH_QUERIES (comma separated)
an own list of queries. Every query is run in full into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from leafspark.plans import catalog  # noqa: E402
from leafspark.plans.flow import image_factors  # noqa: E402
from leafspark.plans.views import Views  # noqa: E402
from leafspark.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_vegetation_share", "idx3_exg_long", "idx20_hv", "idx26_dispatch", "col6_cielab", "seg1_otsu", "seg3_close", "seg5_components", "seg5_contours",
    "tex2_glcm_properties", "tex3_lbp_8", "tex5_hog", "agg21_blob_bands", "shp3_shape_index", "shp9_hull_factors", "shp13_bending",
    "jn2_nearest_blob", "jn5_mask_compare", "jn6_center_angles", "seg7_overlap", "jn11_latest_fix", "jn15_neighbors", "ml11_knn", "ml10_lda",
    "ml27_univariate", "ml33_sweep", "ml33_sweep_pairs", "agg3_scores", "agg13_best_rows", "agg17_summary", "agg29_quartiles", "win1_travel", "win8_auc", "win10_mean_roc",
    "str4_capture", "src9_merge_urls", "src10_training_set", "flow_image_factors"]


def mosaic(spark, folder: str):
    """The 8 x 8 images of the pixel view laid side by side, 32 x 32 of them to a picture of 256 x 256 pixels."""
    place = F.col("image_id") % 1024
    at = lambda c, k: (F.col(c) + 8 * k).cast("int").alias(c)
    return Views(spark, folder).pixels.select(F.floor(F.col("image_id") / 1024).alias("image_id"), at("x", place % 32), at("y", F.floor(place / 32)), "r", "g", "b").cache()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(f"local[{cpus}]", "leafspark-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    pixels, flow = mosaic(spark, folder), None
    if "flow_image_factors" in names:
        many = pixels.count()
        start = time.perf_counter()
        image_factors(pixels, min_area=20).write.format("noop").mode("overwrite").save()
        flow = round((time.perf_counter() - start) / many * 1e6, 2)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
                      "flow_us_per_pixel": flow}))
    spark.stop()


if __name__ == "__main__":
    main()
