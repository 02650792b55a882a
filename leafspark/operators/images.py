"""Operators over pixel tables that need statistics of the whole image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions import color, indices
from leafspark.operators.grouped import with_group_stats

BANDS = ("r", "g", "b")


def normalise_bands(pixels: DataFrame, compat: bool = False) -> DataFrame:
    """Divide each band by its image maximum, then take shares of the sum."""
    p = with_group_stats(pixels, ["image_id"], **{f"max_{c}": F.max(c) for c in BANDS})
    r, g, b = (p[c] / p[f"max_{c}"] for c in BANDS)
    return p.select(*pixels.columns, *[c.alias(n) for n, c in color.chromatic(r, g, b, compat).items()])


def stretch(pixels: DataFrame, value: Column, out: str, top: float = 1.0, keys=("image_id",)) -> DataFrame:
    """Min-max stretch to 0..top per image; a flat image gives 0."""
    p = with_group_stats(pixels.withColumn("_v", value), list(keys), _lo=F.min("_v"), _hi=F.max("_v"))
    scaled = F.when(p._hi == p._lo, 0.0).otherwise((p._v - p._lo) * top / (p._hi - p._lo))
    return p.select(*pixels.columns, scaled.alias(out))


def histogram(pixels: DataFrame, value: Column, keys=("image_id",)) -> DataFrame:
    """keys, v, n: counts per grey level, at most 256 rows per image."""
    return pixels.select(*keys, value.cast("int").alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def equalise(pixels: DataFrame, value: Column, out: str) -> DataFrame:
    """Histogram equalisation per image. The level map is built from at most 256 bins per image and joined back."""
    by_level = Window.partitionBy("image_id").orderBy("v")
    whole = Window.partitionBy("image_id")
    bins = histogram(pixels, value)
    bins = (bins.withColumn("cdf", F.sum("n").over(by_level)).withColumn("total", F.sum("n").over(whole))
            .withColumn("first", F.min_by("n", "v").over(whole)))
    level = F.when(F.col("total") == F.col("first"), F.col("v")).otherwise(
        F.floor((F.col("cdf") - F.col("first")) * 255.0 / (F.col("total") - F.col("first")) + 0.5))
    levels = bins.select("image_id", F.col("v").alias("_v"), level.cast("int").alias(out))
    return pixels.withColumn("_v", value.cast("int")).join(levels, ["image_id", "_v"]).select(*pixels.columns, out)


def compose(pixels: DataFrame, divisor: float, max_value: float = 0.0) -> DataFrame:
    """Three bands scaled for display: divide, scale by the red maximum (at most .4), add the band minimum, clip."""
    stats = {f"min_{c}": F.min(c) / divisor for c in BANDS}
    top = F.lit(max_value / divisor) if max_value > 0 else F.least(F.max("r") / divisor, F.lit(0.4))
    p = with_group_stats(pixels, ["image_id"], _top=top, **stats)
    one = lambda c: F.least(F.greatest(p[f"min_{c}"] + p[c] / divisor / p._top, F.lit(0.0)), F.lit(1.0))
    return p.select(*pixels.columns, *[one(c).alias(f"{c}_scaled") for c in BANDS])


def depth_index(depth: DataFrame) -> DataFrame:
    """Depth index: no-reading cells get the mean, nearer is larger, scaled to 0..1 per frame."""
    p = with_group_stats(depth, ["frame_id"], _mean=F.avg("mm"), _lo=F.min(F.when(F.col("mm") != 0, F.col("mm"))),
                         _hi=F.max("mm"), _zeros=F.count_if(F.col("mm") == 0))
    mean_if_used = F.when(p._zeros > 0, p._mean)
    low, high = F.least(p._lo, mean_if_used), F.greatest(F.when(p._hi > 0, p._hi), mean_if_used)
    filled = F.when(p.mm == 0, p._mean).otherwise(p.mm)
    return p.select(*depth.columns, F.when(high == low, 0.0).otherwise((high - filled) / (high - low)).alias("di"))


def refine(index: DataFrame, depth: DataFrame) -> DataFrame:
    """Weight an index (image_id, x, y, value) by the depth index; negative results become 0."""
    d = depth_index(depth).select(F.col("frame_id").alias("image_id"), "x", "y", "di")
    return index.join(d, ["image_id", "x", "y"]).withColumn("value", F.greatest(F.col("value") * F.col("di"), F.lit(0.0))).drop("di")


def hsi(pixels: DataFrame) -> DataFrame:
    """HSI with the image-wide choice of the hue branch."""
    p = with_group_stats(pixels, ["image_id"], _green=F.bool_or(F.col("g") > F.col("b")))
    return p.select(*pixels.columns, *[c.alias(n) for n, c in color.hsi(p.r, p.g, p.b, p._green).items()])


def hv(pixels: DataFrame) -> DataFrame:
    """HV index: gated hue times the equalised value band, scaled per image column; also the scaled saturation."""
    gates = indices.hv_gates(F.col("r"), F.col("g"), F.col("b"))
    p = equalise(pixels, gates["v"], "_q").withColumns({"_h": gates["h"], "_s": gates["s"]})
    p = with_group_stats(p, ["image_id", "x"], _qlo=F.min("_q"), _qhi=F.max("_q"), _slo=F.min("_s"), _shi=F.max("_s"))
    unit = lambda c: F.when(p[f"{c}hi"] == p[f"{c}lo"], 0.0).otherwise((p[c] - p[f"{c}lo"]) / (p[f"{c}hi"] - p[f"{c}lo"]))
    return p.select(*pixels.columns, (p._h * unit("_q")).alias("hv"), unit("_s").alias("s_scaled"))


def all_indices(pixels: DataFrame) -> DataFrame:
    """image_id, x, y, index, value for every pixel index, as rows; one pass, no shuffle.

    The indices are columns first, so that they share their colour bands and Spark computes those that are read.
    """
    named = {n: indices.index(n, F.col("r"), F.col("g"), F.col("b")).cast("double") for n in indices.PIXEL_INDICES}
    return pixels.select("image_id", "x", "y", *[c.alias(n) for n, c in named.items()]).unpivot(["image_id", "x", "y"], list(named), "index", "value")


def index_summary(pixels: DataFrame) -> DataFrame:
    """image_id, index, mean, top, n: every pixel index aggregated in one wide pass, then turned into rows."""
    named = {n: indices.index(n, F.col("r"), F.col("g"), F.col("b")).cast("double") for n in indices.PIXEL_INDICES}
    values = pixels.select("image_id", *[c.alias(n) for n, c in named.items()])
    wide = values.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.avg(n).alias("mean"), F.max(n).alias("top")).alias(n) for n in named])
    return wide.unpivot(["image_id", "n"], list(named), "index", "s").select("image_id", "index", "s.mean", "s.top", "n")


def clean_depth(depth: DataFrame, limit: int, fill_high: bool = True) -> DataFrame:
    """Readings above the limit and 65535 become 0; zeros then take the largest remaining reading of the frame."""
    cut = F.when((F.col("mm") == 65535) | (F.col("mm") > limit), 0).otherwise(F.col("mm"))
    d = depth.withColumn("mm", cut)
    if not fill_high:
        return d
    d = with_group_stats(d, ["frame_id"], _hi=F.max("mm"))
    return d.withColumn("mm", F.when(d.mm == 0, d._hi).otherwise(d.mm)).drop("_hi")


def smooth_depth(depth: DataFrame) -> DataFrame:
    """0 where the next reading in the row is closer than one standard deviation of the frame's readings.

    The last two cells of a row and the last row stay. Windows run per image row, so a large frame is split.
    """
    d = with_group_stats(depth, ["frame_id"], _sd=F.stddev_pop(F.when(F.col("mm") > 0, F.col("mm"))),
                         _w=F.max("x") + 1, _h=F.max("y") + 1)
    follow = F.lead("mm").over(Window.partitionBy("frame_id", "y").orderBy("x"))
    d = d.withColumn("_next", follow)
    change = (d.x < d._w - 2) & (d.y < d._h - 1) & (F.abs(d.mm - d._next) < d._sd)
    return d.select(*[c for c in depth.columns if c != "mm"], F.when(change, 0).otherwise(d.mm).alias("mm"))


def depth_subset(depth: DataFrame, a_rgb, b_rgb, a_depth, b_depth, size) -> DataFrame:
    """The part of a depth frame seen by the colour camera, from two markers seen in both. Adds colour coordinates."""
    ratio = abs(a_depth[0] - b_depth[0]) / abs(a_rgb[0] - b_rgb[0])
    left, top = int(a_depth[0] - a_rgb[0] * ratio), int(a_depth[1] - a_rgb[1] * ratio)
    wide, high = int(size[0] * ratio), int(size[1] * ratio)
    inside = (F.col("x") >= left) & (F.col("x") < left + wide) & (F.col("y") >= top) & (F.col("y") < top + high)
    return depth.filter(inside).withColumns({"rgb_x": F.floor((F.col("x") - left) / ratio).cast("int"),
                                             "rgb_y": F.floor((F.col("y") - top) / ratio).cast("int")})


def transect(pixels: DataFrame, band: str, y: int, x: int | None = None, length: int | None = None) -> DataFrame:
    """One image row (or part of it) per image, with its maximum and the first place of it."""
    cut = F.col("y") == y
    if length is not None:
        cut = cut & F.col("x").between(x, x + length - 1)
    row = pixels.filter(cut)
    return row.groupBy("image_id").agg(F.max(band).alias("peak"),
                                       F.max_by("x", F.struct(F.col(band), -F.col("x"))).alias("peak_x"),
                                       F.min(band).alias("low"), F.count(F.lit(1)).alias("n"))


def crop_blobs(pixels: DataFrame, blobs: DataFrame) -> DataFrame:
    """Pixels inside each blob's box. Boxes are cut to the size of their image and spread over their pixels, so the
    join is an equality join on the pixel and stays even for one large image."""
    size = pixels.groupBy("image_id").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    b = blobs.join(size, "image_id").select(
        "image_id", "blob_id", F.greatest("x", "_x0").alias("x0"), F.least(F.col("x") + F.col("w") - 1, F.col("_x1")).alias("x1"),
        F.greatest("y", "_y0").alias("y0"), F.least(F.col("y") + F.col("h") - 1, F.col("_y1")).alias("y1"))
    rows = b.filter("x0 <= x1 and y0 <= y1").select("image_id", "blob_id", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y"))
    cells = rows.select("image_id", "blob_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return cells.join(pixels, ["image_id", "x", "y"])
