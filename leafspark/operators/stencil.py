"""Neighbourhood operators on pixel tables.

A pixel sends its value to the places that need it, and one shuffle on (image, x, y) collects what each place
received. Work is spread over single pixels, so one large image does not fill one task, and no self join is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.operators.contours import components, find_blobs  # noqa: F401
from leafspark.operators.images import histogram

# 7-tap Gaussian in 64ths.
GAUSS7 = (2, 7, 14, 18, 14, 7, 2)


def neighbours(pixels: DataFrame, value: Column, offsets: dict[str, tuple[int, int]], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """keys, x, y, v and one column per offset with the value found at (x + dx, y + dy); null outside the image."""
    sends = [F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.lit("").alias("slot"))]
    sends += [F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(n).alias("slot")) for n, (dx, dy) in offsets.items()]
    sent = pixels.select(*keys, value.alias("_v"), F.explode(F.array(*sends)).alias("s")).select(*keys, "s.*", "_v")
    got = lambda n: F.max(F.when(F.col("slot") == n, F.col("_v")))
    gathered = sent.groupBy(*keys, "x", "y").agg(got("").alias("v"), *[got(n).alias(n) for n in offsets])
    return gathered.filter("v is not null")


def _pass(pixels: DataFrame, axis: str, places: Column, combine, keys) -> DataFrame:
    """Send each value along one axis to the given places (array of (at, weight)) and combine."""
    other = "y" if axis == "x" else "x"
    sent = pixels.select(*keys, other, "v", F.inline(places))
    return sent.groupBy(*keys, F.col("at").alias(axis), other).agg(combine.alias("v"))


def blur(pixels: DataFrame, width: int, height: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """7 x 7 Gaussian of ``v`` with mirrored borders, in two one-axis passes; whole-number sums, rounded once."""
    def places(axis, size):
        c, n = F.col(axis), size - 1
        spots = []
        for d in range(-3, 4):
            w = F.lit(GAUSS7[d + 3])
            spots += [F.struct((c - d).alias("at"), w.alias("w"))]
            spots += [F.struct(F.when(c > 0, -c - d).alias("at"), w.alias("w"))]
            spots += [F.struct(F.when(c < n, 2 * n - c - d).alias("at"), w.alias("w"))]
        # A mirrored place is used only where the mirrored reading lies outside the image.
        def valid(s, d, kind):
            at = s["at"]
            inside = (at >= 0) & (at <= n)
            return inside if kind == 0 else inside & ((at + d < 0) if kind == 1 else (at + d > n))
        kept = [F.when(valid(s, i // 3 - 3, i % 3), s) for i, s in enumerate(spots)]
        return F.array_compact(F.array(*kept))
    total = F.sum(F.col("v") * F.col("w"))
    across = _pass(pixels.select(*keys, "x", "y", F.col("v").cast("long").alias("v")), "x", places("x", width), total, keys)
    down = _pass(across, "y", places("y", height), total, keys)
    return down.withColumn("v", F.floor(F.col("v") / 4096.0 + 0.5).cast("int"))


def morphology(mask: DataFrame, width: int, height: int, size: int = 5, grow: bool = True, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Dilation (``grow``) or erosion of ``v`` by a square; places outside the image do not count."""
    half = size // 2
    combine = F.max("v") if grow else F.min("v")

    def places(axis, limit):
        at = F.filter(F.sequence(F.col(axis) - half, F.col(axis) + half), lambda a: (a >= 0) & (a < limit))
        return F.transform(at, lambda a: F.struct(a.alias("at"), F.lit(1).alias("w")))
    return _pass(_pass(mask, "x", places("x", width), combine, keys), "y", places("y", height), combine, keys)


def close_mask(mask: DataFrame, width: int, height: int, size: int = 5) -> DataFrame:
    return morphology(morphology(mask, width, height, size, True), width, height, size, False)


def otsu_bins(pixels: DataFrame, value: Column, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Histogram rows (keys, v, n) with the image's Otsu ``threshold``; a flat image gets 0.

    One shuffle: the windows run over the at most 256 histogram rows of an image.
    """
    along = Window.partitionBy(*keys).orderBy("v")
    whole = Window.partitionBy(*keys)
    h = histogram(pixels, value, keys).withColumns({"_n": F.sum("n").over(along), "_s": F.sum(F.col("n") * F.col("v")).over(along),
                                                    "_tn": F.sum("n").over(whole), "_ts": F.sum(F.col("n") * F.col("v")).over(whole)})
    n, s, tn, ts = (F.col(c).cast("double") for c in ("_n", "_s", "_tn", "_ts"))
    split = (ts * n - s * tn) * (ts * n - s * tn) / (n * (tn - n))
    last = F.col("_n") == F.col("_tn")
    h = h.withColumns({"_score": F.when(last, -1.0).otherwise(F.round(split, 3)), "_level": F.when(last, 0).otherwise(F.col("v"))})
    return h.withColumn("threshold", F.max_by("_level", F.struct("_score", -F.col("_level"))).over(whole)).select(*keys, "v", "n", "threshold")


def otsu(pixels: DataFrame, value: Column, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Otsu threshold per image from its histogram."""
    return otsu_bins(pixels, value, keys).groupBy(*keys).agg(F.first("threshold").alias("threshold"))


def triangle(pixels: DataFrame, value: Column, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Triangle threshold per image: the level farthest from the line between the peak and the longer tail's end."""
    bins = histogram(pixels, value, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    dense = bins.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("h"))
    used = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda i: F.element_at("h", i + 1) > 0)
    d = dense.withColumns({"left": F.greatest(F.array_min(used) - 1, F.lit(0)), "right": F.least(F.array_max(used) + 1, F.lit(255)),
                           "peak": (F.array_position("h", F.array_max("h")) - 1).cast("int")})
    d = d.withColumn("flip", F.col("peak") - F.col("left") < F.col("right") - F.col("peak"))
    d = d.select(*keys, "flip", F.when(F.col("flip"), F.reverse("h")).otherwise(F.col("h")).alias("h"),
                 F.when(F.col("flip"), 255 - F.col("right")).otherwise(F.col("left")).alias("left"),
                 F.when(F.col("flip"), 255 - F.col("peak")).otherwise(F.col("peak")).alias("peak"))
    d = d.withColumn("top", F.element_at("h", F.col("peak") + 1))
    distance = lambda i: F.col("top") * i + (F.col("left") - F.col("peak")) * F.element_at("h", i + 1)
    steps = F.when(F.col("peak") > F.col("left"), F.sequence(F.col("left") + 1, F.col("peak")))
    far = F.array_max(F.transform(steps, lambda i: F.struct(distance(i).alias("d"), (-i).alias("i"))))
    level = F.when(far["d"] > 0, -far["i"]).otherwise(F.col("left")) - 1
    return d.select(*keys, F.when(F.col("flip"), 255 - level).otherwise(level).alias("threshold"))


def boundary(mask: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mask pixels with at least one of their eight neighbours outside the mask."""
    around = [F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(int(dx == 0 and dy == 0)).alias("own"))
              for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    sent = mask.filter("v > 0").select(*keys, F.inline(F.array(*around)))
    counts = sent.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    return counts.filter((F.col("own") == 1) & (F.col("n") < 9)).select(*keys, "x", "y")
