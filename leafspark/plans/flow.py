"""The whole way from pixels to a factor table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.functions import indices, rules
from leafspark.functions.catalog_of_factors import select_factors
from leafspark.operators import blob_texture, contours, shape, stencil, texture, tiles
from leafspark.operators.grouped import join_keys, ordered_scan
from leafspark.session import FEW_ROWS, beside, cut_lineage, no_broadcasts

KEYS = ["image_id", "blob_id"]


def vegetation_mask(pixels: DataFrame, index: str = "exg") -> DataFrame:
    """image_id, x, y, v: the index as a byte, cut at the image's Otsu threshold."""
    value = F.pmod(indices.index(index, *[F.col(c) for c in "rgb"]).cast("int"), F.lit(256))
    levels = pixels.select("image_id", "x", "y", value.alias("e"))
    cut = stencil.otsu(levels, F.col("e"))
    return join_keys(levels, cut, ["image_id"]).select("image_id", "x", "y", rules.threshold_mask(F.col("e"), F.col("threshold")).alias("v"))


def shape_table(blobs: DataFrame, width: Column, sizes: DataFrame) -> DataFrame:
    """KEYS and the shape factors of the blobs' traced contours. sizes: image_id and what width needs."""
    traced = cut_lineage(join_keys(contours.contours(blobs), beside(sizes), ["image_id"]))
    tables = [shape.shape_factors(traced, width).drop("area"), shape.hull_factors(traced), shape.bending(traced), shape.radial(traced)]
    out = tables[0]
    for table in tables[1:]:
        out = join_keys(out, table, KEYS)
    return out


def image_factors(pixels: DataFrame, min_area: int = 0, image_width: int | None = None, agl: Column | None = None, tile: int = tiles.TILE) -> DataFrame:
    """One row per blob with every factor of the catalogue: geometry, colour, shape of the traced contour, texture on all
    bands and position; edge blobs are marked. ``agl`` is a column of pixels, the same for an image.

    Texture and contours are worked out in tiles, so neither an image nor a blob fills a task. Pixels without an image
    are one image.
    """
    named = contours.name_images(pixels.withColumn("_agl", F.lit(None).cast("double") if agl is None else agl.cast("double")))
    images = cut_lineage(named.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"), F.bool_or(F.col("g") > F.col("b")).alias("any_green"), F.max("_agl").alias("agl")))
    width = F.col("_w") if image_width is None else F.lit(image_width)
    owner = lambda place: tiles.tile_of(place, blob_texture.REACH, tile)
    span = lambda c, n: owner(F.col(c)) != owner(F.col(c) + F.col(n) - 1)
    with no_broadcasts(pixels.sparkSession, images.count() > FEW_ROWS):
        blobs = cut_lineage(contours.find_blobs(vegetation_mask(named), min_area, tile))
        # Byte bands are written with the pixels, the others follow from the image too: all in one expression would be more than Spark compiles.
        bands = [F.col(c) for c in "rgb"]
        plain = blob_texture.byte_columns(*bands)
        own = blobs.join(named.select("image_id", "x", "y", "r", "g", "b").hint("merge"), ["image_id", "x", "y"])
        inside = cut_lineage(own.select("*", *[c.alias(n) for n, c in plain.items()]))
        seen = inside.join(beside(images.select("image_id", "any_green")), "image_id")
        every = blob_texture.band_columns(*bands, F.col("any_green"))
        floats = {n: F.col(n) for n in blob_texture.FLOATS}
        wide = seen.select("*", *[every[n].alias(n) for n in floats])
        tones = {"hue": F.col("hsv_hue"), "saturation": F.col("hsv_saturation"), "in_phase": F.col("yiq_i"), "cb": F.col("ycbcr_cb")}
        facts = cut_lineage(shape.blob_geometry(wide, KEYS, [*shape.band_aggregates(tones), *blob_texture.float_ranges(floats)]))
        ranges = [c for c in facts.columns if c.startswith(("_lo_", "_hi_"))]
        boxes = facts.select(*KEYS, F.col("x").alias("x0"), F.col("y").alias("y0"), (span("x", "w") | span("y", "h")).alias("split"), *ranges)
        ready = wide.join(beside(boxes), KEYS).withColumn("peaks", blob_texture.peaks(floats)).drop(*floats)
        numbers, cells = blob_texture.texture_numbers(ready, tile)
        grid = facts.select(*KEYS, F.floor(F.col("h") / blob_texture.CELL).cast("int").alias("rows"), F.floor(F.col("w") / blob_texture.CELL).cast("int").alias("cols"))
        cells = cells.join(beside(grid), KEYS).filter("row < rows and col < cols")
        hog = cut_lineage(texture.hog_stats(texture.hog_descriptor(cells, KEYS), KEYS))
        shapes = cut_lineage(shape_table(blobs, width, images.select("image_id", "_w")).drop("elongation"))
        counted = cut_lineage(ordered_scan(facts.drop(*ranges), ["image_id"], ["blob_id"], F.floor(F.col("y") / tile), rank="number"))
    # The caller plans these joins; the numbers of texture are wide, the others have a row a blob at most.
    joined = numbers.join(beside(counted), KEYS).join(beside(shapes), KEYS).join(beside(hog), KEYS, "left").join(beside(images.drop("any_green")), "image_id")
    edge = rules.at_edge(F.col("x"), F.col("w"), width)
    gap = F.abs(F.col("cy") - F.floor(F.col("_h") / 2))
    columns = [F.col(c) for c in ("area", "x", "y", "w", "h", "size_ratio")]
    made = {"elongation": F.col("w") / F.col("h"), "hue": F.col("hue_mean"), "saturation_mean": F.col("saturation_mean"), "in_phase": F.col("in_phase_stddev"), "cb_mean": F.col("cb_mean"),
            "normalized_distance": gap / F.col("_h")}
    found = joined.select(*joined.columns, *blob_texture.texture_columns())
    rest = [F.col(c) for c in [*select_factors(), *select_factors(kind="VECTOR")] if c not in made]
    out = found.select("image_id", "blob_id", *columns, *[c.alias(n) for n, c in made.items()], *rest, F.lit(rules.UNKNOWN).alias("type"),
                       F.when(edge, rules.REASON_AT_EDGE).otherwise(0).alias("reason"), (F.col("number") - 1).alias("number"), "agl")
    out = contours.restore_images(out, pixels.schema["image_id"].dataType.simpleString())
    name = F.concat_ws("-", F.concat(F.lit("image-"), F.col("image_id").cast("string")), F.concat(F.lit("blob"), F.col("blob_id").cast("string")))
    return out.select("image_id", "blob_id", name.alias("name"), *[c for c in out.columns if c not in KEYS])
