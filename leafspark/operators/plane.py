"""Joins and counts in the image plane.

Distance joins run as equality joins on grid cells. Points that share a position are merged
before the join, so many copies of one spot cost one row.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions import rules
from leafspark.operators.grouped import join_keys, ordered_scan, top_by, with_group_stats
from leafspark.session import cut_lineage


WINDOW_LEVELS = 16
FEW_CENTERS = 4096


def _cell(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("int")


def _cells(c: Column, reach, size: int) -> Column:
    return F.explode(F.sequence(_cell(c - reach, size), _cell(c + reach, size)))


def _few_and_many(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of images that one task can hold, and those of images with many rows or a null."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    sized = cut_lineage(with_group_stats(df, ["image_id"], _n=F.count(F.lit(1)), _known=F.count_if(known)))
    few = (F.col("_n") <= FEW_CENTERS) & (F.col("_known") == F.col("_n"))
    return sized.filter(few).select(*df.columns), sized.filter(~few).select(*df.columns)


def nearest_blob(lids: DataFrame, blobs: DataFrame, cutoff: int = 999, first_reach: int = 64) -> DataFrame:
    """The nearest blob of each lid in its image, null when none is closer than the cutoff; ties go to the lower id.

    lids: image_id, lid_id, lx, ly. blobs: image_id, blob_id, cx, cy. A short reach is tried first; lids without a blob
    there try twice the reach, up to the cutoff, so a lid meets few blobs beyond its nearest one. Sizes of files say little
    about rows in memory and nothing about cells, so no side is broadcast.
    """
    spots = cut_lineage(blobs.groupBy("image_id", "cx", "cy").agg(F.min("blob_id").alias("blob_id")))
    waiting = cut_lineage(lids.select("image_id", "lx", "ly").distinct())
    found, reach = None, min(first_reach, cutoff)
    while True:
        size = reach + 1
        probe = waiting.select("*", _cells(F.col("lx"), reach, size).alias("gx")) \
            .select("*", _cells(F.col("ly"), reach, size).alias("gy"))
        binned = spots.withColumns({"gx": _cell(F.col("cx"), size), "gy": _cell(F.col("cy"), size)})
        squared = (F.pow(F.col("lx") - F.col("cx"), 2) + F.pow(F.col("ly") - F.col("cy"), 2)).cast("long")
        limit = squared <= reach * reach if reach < cutoff else squared < cutoff * cutoff
        hits = (probe.join(binned.hint("merge"), ["image_id", "gx", "gy"]).withColumn("d2", squared).filter(limit)
                .groupBy("image_id", "lx", "ly").agg(F.min(F.struct("d2", "blob_id")).alias("best")))
        hits = cut_lineage(hits)
        found = hits if found is None else found.unionByName(hits)
        if reach == cutoff:
            break
        waiting = cut_lineage(waiting.join(hits.hint("merge"), ["image_id", "lx", "ly"], "left_anti"))
        if waiting.isEmpty():
            break
        reach = min(2 * reach, cutoff)
    joined = lids.join(found.hint("merge"), ["image_id", "lx", "ly"], "left")
    return joined.select("image_id", "lid_id", F.col("best.blob_id").alias("blob_id"),
                         F.sqrt(F.col("best.d2").cast("double")).alias("distance"))


def stickers_in_lids(lids: DataFrame, stickers: DataFrame, size: int = 64) -> DataFrame:
    """How many sticker circles lie wholly inside each lid circle. Both: image_id, x, y, r; lids also lid_id."""
    spots = stickers.groupBy("image_id", "x", "y", "r").agg(F.count(F.lit(1)).alias("m")) \
        .select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("r").alias("sr"), "m",
                _cell(F.col("x"), size).alias("gx"), _cell(F.col("y"), size).alias("gy"))
    shapes = lids.select("image_id", "x", "y", "r").distinct() \
        .select("*", _cells(F.col("x"), F.col("r"), size).alias("gx")) \
        .select("*", _cells(F.col("y"), F.col("r"), size).alias("gy"))
    gap = F.col("r") - F.col("sr")
    inside = (gap > 0) & (F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2) < gap * gap)
    counts = shapes.join(spots, ["image_id", "gx", "gy"]).filter(inside) \
        .groupBy("image_id", "x", "y", "r").agg(F.sum("m").alias("stickers"))
    return lids.join(counts, ["image_id", "x", "y", "r"], "left").select(
        "image_id", "lid_id", F.coalesce("stickers", F.lit(0)).alias("stickers"))


def lids_at_blobs(lids: DataFrame, blobs: DataFrame, reach: int = 10) -> DataFrame:
    """Lid and blob pairs whose centers differ by at most ``reach`` on both axes."""
    size = 2 * reach + 1
    probe = lids.select("*", _cells(F.col("lx"), reach, size).alias("gx")).select("*", _cells(F.col("ly"), reach, size).alias("gy"))
    binned = blobs.select("image_id", "blob_id", "cx", "cy").withColumns(
        {"gx": _cell(F.col("cx"), size), "gy": _cell(F.col("cy"), size)})
    near = (F.abs(F.col("lx") - F.col("cx")) <= reach) & (F.abs(F.col("ly") - F.col("cy")) <= reach)
    return probe.join(binned, ["image_id", "gx", "gy"]).filter(near).select("image_id", "lid_id", "blob_id")


def box_cover(blobs: DataFrame) -> DataFrame:
    """Number of blob boxes over each blob center, its own included: image_id, cx, cy, cover.

    The rows of a box are covered by a few aligned bands of 1, 2, 4, ... rows, and a center lies in one band of each
    height. Along one band a running sum of box starts minus ends gives the boxes over a column; a center adds up its
    bands. Events that share a place are merged first, so a band holds at most one event per column. The few boxes of a
    small image are compared directly.
    """
    few, blobs = _few_and_many(blobs.select("image_id", "x", "y", "w", "h", "cx", "cy"))

    def of_image(image: pd.DataFrame) -> pd.DataFrame:
        x, y, w, h = (image[c].to_numpy().astype(np.int64) for c in "xywh")
        spots = np.unique(np.stack([image.cx.to_numpy(), image.cy.to_numpy()], axis=1), axis=0)
        cover = np.zeros(len(spots), np.int64)
        for start in range(0, len(spots), 512):
            cx, cy = spots[start:start + 512, :1], spots[start:start + 512, 1:]
            steps = (x <= cx).astype(np.int8) - (x + w <= cx)
            cover[start:start + 512] = (steps * ((y <= cy) & (cy < y + h))).sum(axis=1)
        return pd.DataFrame({"image_id": image.image_id.iloc[0], "cx": spots[:, 0], "cy": spots[:, 1], "cover": cover})

    tallest = blobs.agg(F.max("h")).first()[0] or 1
    levels = range(int(tallest).bit_length())
    x, y, end = F.col("x"), F.col("y"), F.col("y") + F.col("h")
    pieces = []
    for level in levels:
        low, high = F.ceil(y / (1 << level)), F.floor(end / (1 << level))
        for band, used in ((low, low % 2 != 0), (high - 1, high % 2 != 0)):
            pieces.append(F.when((low < high) & used, F.struct(F.lit(level).alias("level"), band.alias("band"))))
    bands = blobs.select("image_id", "x", "w", F.inline(F.array_compact(F.array(*pieces))))
    events = bands.select("image_id", "level", "band", F.inline(F.array(
        F.struct(x.alias("x"), F.lit(1).alias("step")), F.struct((x + F.col("w")).alias("x"), F.lit(-1).alias("step")))))
    spots = blobs.select("image_id", "cx", "cy").distinct()
    asked = spots.select("image_id", F.col("cx").alias("x"), "cy", F.explode(F.array(*[F.lit(k) for k in levels])).alias("level"))
    asked = asked.withColumn("band", F.floor(F.col("cy") / F.pow(F.lit(2), F.col("level"))))
    steps = events.groupBy("image_id", "level", "band", "x").agg(F.sum("step").alias("step"))
    both = steps.withColumn("cy", F.lit(None).cast("int")).unionByName(asked.withColumn("step", F.lit(0).cast("long")))
    # A range frame includes every event at the same column, wherever it sorts.
    along = Window.partitionBy("image_id", "level", "band").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("cover", F.sum("step").over(along)).filter("cy is not null")
    banded = seen.groupBy("image_id", F.col("x").alias("cx"), "cy").agg(F.sum("cover").alias("cover"))
    return banded.unionByName(few.groupBy("image_id").applyInPandas(of_image, ", ".join(f"{n} {t}" for n, t in banded.dtypes)))


def ignore_overlaps(blobs: DataFrame) -> DataFrame:
    """Blobs whose center lies inside another blob's box become ignored."""
    b = join_keys(blobs, box_cover(blobs), ["image_id", "cx", "cy"])
    return b.withColumn("type", F.when(b.cover > 1, rules.IGNORED).otherwise(b.type)).select(*blobs.columns)


def level_counts(centers: DataFrame, max_angle: float = 5.0, chunk: int = 16) -> DataFrame:
    """For each center: how many centers of its image (itself included) lie within ``max_angle`` degrees of its
    horizontal, and how many do not. No pair of centers is built.

    With t = tan(angle), a neighbour is level when it is to the lower right or upper left in the sheared
    coordinates u = y - t x and v = y + t x. Such dominance counts split by halving the u-order: at every
    level the left half of a block is counted into the right half by one running sum along v, and back. The few centers
    of a small image are compared directly.
    """
    t = math.tan(math.radians(max_angle))
    few, spots = _few_and_many(centers.groupBy("image_id", "cx", "cy").agg(F.count(F.lit(1)).alias("m")))

    def of_image(image: pd.DataFrame) -> pd.DataFrame:
        cx, cy = image.cx.to_numpy().astype(float), image.cy.to_numpy().astype(float)
        u, v = cy - cx * t, cy + cx * t
        order = np.lexsort((-v, u))
        v, m = v[order], image.m.to_numpy()[order]
        level = m.copy()
        for start in range(0, len(v), 512):
            some = slice(start, start + 512)
            later = np.triu(v[some, None] >= v, start + 1)
            level[some] += (later * m).sum(axis=1)
            level += (later * m[some, None]).sum(axis=0)
        return pd.DataFrame({"image_id": image.image_id.iloc[0], "cx": image.cx.to_numpy()[order], "cy": image.cy.to_numpy()[order], "level": level, "total": m.sum()})

    sizes = spots.groupBy("image_id").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("size"))
    spots = spots.withColumns({"u": F.col("cy") - F.col("cx") * t, "v": F.col("cy") + F.col("cx") * t})
    ranked = ordered_scan(spots, ["image_id"], [F.col("u"), -F.col("v")], F.floor(F.col("u") / chunk), rank="pos")
    ranked = cut_lineage(join_keys(ranked, sizes, ["image_id"]))
    depth = F.greatest(F.ceil(F.log2(F.col("size").cast("double"))).cast("int") - 1, F.lit(0))
    place = F.col("pos") - 1
    spread = ranked.withColumn("level", F.explode(F.sequence(F.lit(0), depth)))
    bit = F.expr("shiftright(pos - 1, level)")
    spread = spread.withColumns({"half": bit % 2, "block": F.floor(bit / 2)}).drop("size")
    keys = ["image_id", "level", "block"]
    left = F.when(F.col("half") == 0, F.col("m")).otherwise(0)
    right = F.when(F.col("half") == 1, F.col("m")).otherwise(0)
    # A block of level l has at most 2^(l+1) rows: small blocks take one window, larger ones an ordered scan.
    along = Window.partitionBy(*keys).orderBy(-F.col("v"), "half").rowsBetween(Window.unboundedPreceding, 0)
    small = spread.filter(F.col("level") < WINDOW_LEVELS).withColumns({
        "left_seen": F.sum(left).over(along), "right_seen": F.sum(right).over(along), "right_all": F.sum(right).over(Window.partitionBy(*keys))})
    large = ordered_scan(spread.filter(F.col("level") >= WINDOW_LEVELS), keys, [-F.col("v"), F.col("half")], F.floor(-F.col("v") / chunk),
                         sums={"left_seen": left, "right_seen": right})
    large = with_group_stats(large, keys, right_all=F.sum(right))
    scanned = small.unionByName(large)
    part = F.when(F.col("half") == 1, F.col("left_seen")).otherwise(F.col("right_all") - F.col("right_seen"))
    counts = scanned.groupBy("image_id", "cx", "cy").agg(
        (F.sum(part) + F.max("m")).alias("level"), F.max("total").alias("total"))
    counts = counts.unionByName(few.groupBy("image_id").applyInPandas(of_image, ", ".join(f"{n} {t}" for n, t in counts.dtypes)))
    return centers.join(counts, ["image_id", "cx", "cy"]).select(
        "image_id", "blob_id", "cx", "cy", "level", (F.col("total") - F.col("level")).alias("off_level"))


def crop_line(blobs: DataFrame, height: int, candidates: int = 5) -> DataFrame:
    """The center that marks the crop line: of the five centers with the fewest off-level neighbours, the one
    nearest to the middle row. Undesired and ignored blobs do not take part."""
    counts = level_counts(blobs.filter(~F.col("type").isin(rules.UNDESIRED, rules.IGNORED)))
    order = Window.partitionBy("image_id").orderBy("off_level", "blob_id")
    few = counts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= candidates)
    few = few.withColumn("gap", F.abs(F.lit(height // 2) - F.col("cy")))
    best = top_by(few, ["image_id"], [F.col("gap"), F.col("n")], largest=False)
    return best.select("image_id", "blob_id", F.col("cy").alias("crop_y"), "off_level")


def crop_distances(blobs: DataFrame, crop_y: int, height: int) -> DataFrame:
    gap = F.abs(F.col("cy") - crop_y)
    return blobs.withColumns({"distance": gap, "normalized_distance": gap / height})


def leading_edge(blobs: DataFrame, width: int, pixel_mm: float) -> DataFrame:
    return blobs.withColumn("leading", (F.lit(width) - F.col("x")) * pixel_mm)


def row_votes(centers: DataFrame, step_degrees: int = 1, rho_size: int = 1, best: int | None = None) -> DataFrame:
    """Votes of centers for straight lines (image_id, theta, rho, votes). Fixed fan-out per center, map-side combine.

    With ``best``, an image of few centers is counted in one place, which lets go of all but its ``best`` lines by votes, theta and rho.
    """
    angles = range(0, 180, step_degrees)
    turns = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles]

    def spread(some: DataFrame) -> DataFrame:
        lines = F.array(*[F.struct(F.lit(a).alias("theta"), F.lit(c).alias("c"), F.lit(s).alias("s")) for a, (c, s) in zip(angles, turns)])
        rho = F.floor((F.col("cx") * F.col("c") + F.col("cy") * F.col("s")) / rho_size + 0.5).cast("int").alias("rho")
        return some.select("image_id", "cx", "cy", F.inline(lines)).groupBy("image_id", "theta", rho).agg(F.count(F.lit(1)).alias("votes"))
    if best is None:
        return spread(centers)

    def of_image(image: pd.DataFrame) -> pd.DataFrame:
        cos, sin = np.array(turns).T
        rho = np.floor((image.cx.to_numpy()[:, None] * cos + image.cy.to_numpy()[:, None] * sin) / rho_size + 0.5).astype(np.int64)
        low, span = rho.min(), rho.max() - rho.min() + 1
        lines, votes = np.unique(np.arange(len(cos)) * span + (rho - low), return_counts=True)
        first = np.argsort(-votes, kind="stable")[:best]
        return pd.DataFrame({"image_id": image.image_id.iloc[0], "theta": np.array(angles)[lines[first] // span], "rho": lines[first] % span + low, "votes": votes[first]})

    few, many = _few_and_many(centers.select("image_id", "cx", "cy"))
    kind = few.schema["image_id"].dataType.simpleString()
    counted = few.groupBy("image_id").applyInPandas(of_image, f"image_id {kind}, theta int, rho int, votes bigint")
    return counted.unionByName(spread(many))


def best_lines(votes: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.desc("votes"), "theta", "rho")
    return votes.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def treatment_plan(blobs: DataFrame, mask: DataFrame, height: int, size: int) -> DataFrame:
    """Grid cells under undesired boxes that hold vegetation: image_id, row, col, type.

    mask: image_id, x, y, v. Boxes are walked at grid steps from their corner.
    """
    undesired = blobs.filter(F.col("type") == rules.UNDESIRED)
    cells = undesired.select("image_id", "y", "h", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1, F.lit(size))).alias("px")) \
        .select("image_id", "px", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1, F.lit(size))).alias("py"))
    row = F.floor((F.lit(height) - F.col("py")) / size).cast("int") + 1
    wanted = cells.select("image_id", row.alias("row"), F.floor(F.col("px") / size).cast("int").alias("col")).distinct()
    green = mask.filter("v > 0").select(
        "image_id", F.ceil((F.lit(height) - F.col("y")) / size).cast("int").alias("row"),
        F.floor(F.col("x") / size).cast("int").alias("col"))
    return wanted.join(green, ["image_id", "row", "col"], "left_semi").withColumn("type", F.lit(rules.UNDESIRED))


def full_squares(cells: DataFrame, size: int, keys=("image_id", "blob_id")) -> DataFrame:
    """Aligned squares that lie wholly inside a blob. cells: keys, x, y (one row per blob pixel)."""
    return (cells.groupBy(*keys, _cell(F.col("x"), size).alias("col"), _cell(F.col("y"), size).alias("row"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size * size)
            .select(*keys, (F.col("col") * size).alias("x"), (F.col("row") * size).alias("y")))
