"""Texture factors per blob: grey-level co-occurrence, local binary patterns, oriented gradients.

Input rows are keys, x, y and an integer band ``v``; keys name the blob.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.operators.grouped import with_group_stats
from leafspark.operators.stencil import neighbours

# Offsets (dx, dy) of the five angles at distance 1.
ANGLES = {"0": (1, 0), "45": (1, 1), "90": (0, 1), "135": (-1, 1), "180": (-1, 0)}
PROPERTIES = ["energy", "contrast", "dissimilarity", "homogeneity", "ASM", "correlation"]


def to_levels(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Floating bands become whole levels: stretched to 0..1 per blob and cut."""
    p = with_group_stats(pixels, keys, _lo=F.min("v"), _hi=F.max("v"))
    level = F.when(p._hi == p._lo, 0).otherwise(F.floor((p.v - p._lo) / (p._hi - p._lo))).cast("int")
    return p.withColumn("v", level).drop("_lo", "_hi")


def glcm(pixels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Counts of neighbouring grey levels: keys, angle, i, j, n."""
    near = neighbours(pixels, F.col("v"), {f"a{a}": o for a, o in ANGLES.items()}, keys)
    pairs = F.array(*[F.struct(F.lit(a).alias("angle"), F.col("v").alias("i"), F.col(f"a{a}").alias("j")) for a in ANGLES])
    return near.select(*keys, F.inline(pairs)).filter("j is not null").groupBy(*keys, "angle", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def glcm_properties(counts: DataFrame, keys: Sequence[str] = ("image_id",), average: bool = True) -> DataFrame:
    """The six properties per angle, or their mean over the angles."""
    n, gap = F.col("n"), F.col("i") - F.col("j")
    sums = counts.groupBy(*keys, "angle").agg(
        F.sum("n").alias("t"), F.sum(n * n).alias("nn"), F.sum(n * gap * gap).alias("c"), F.sum(n * F.abs(gap)).alias("d"),
        F.sum(n / (1 + gap * gap)).alias("h"), F.sum(n * F.col("i")).alias("si"), F.sum(n * F.col("j")).alias("sj"),
        F.sum(n * F.col("i") * F.col("i")).alias("sii"), F.sum(n * F.col("j") * F.col("j")).alias("sjj"),
        F.sum(n * F.col("i") * F.col("j")).alias("sij"))
    t = F.col("t")
    var = lambda s, ss: (F.col(ss) * t - F.col(s) * F.col(s)).cast("double")
    spread = F.sqrt(var("si", "sii")) * F.sqrt(var("sj", "sjj"))
    correlation = F.when(spread == 0, 1.0).otherwise((F.col("sij") * t - F.col("si") * F.col("sj")) / spread)
    asm = F.col("nn") / (t * t)
    per_angle = sums.select(*keys, "angle", F.sqrt(asm).alias("energy"), (F.col("c") / t).alias("contrast"), (F.col("d") / t).alias("dissimilarity"),
                            (F.col("h") / t).alias("homogeneity"), asm.alias("ASM"), correlation.alias("correlation"))
    return per_angle.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in PROPERTIES]) if average else per_angle


def sample_points(points: int = 24, radius: float = 8.0) -> list[tuple[float, float]]:
    """(dy, dx) of the sampling circle, rounded to five places."""
    angle = lambda p: 2 * math.pi * p / points
    return [(round(-radius * math.sin(angle(p)), 5), round(radius * math.cos(angle(p)), 5)) for p in range(points)]


def bilinear_parts(dy: float, dx: float) -> list[tuple[int, int, float]]:
    """(row, column, weight) of the four pixels around a sample."""
    y0, x0 = math.floor(dy), math.floor(dx)
    fy, fx = dy - y0, dx - x0
    return [(y0, x0, (1 - fy) * (1 - fx)), (y0, x0 + 1, (1 - fy) * fx), (y0 + 1, x0, fy * (1 - fx)), (y0 + 1, x0 + 1, fy * fx)]


def lbp_codes(pixels: DataFrame, keys: Sequence[str] = ("image_id",), points: int = 24, radius: float = 8.0, tile: int = 64) -> DataFrame:
    """Uniform pattern code 0..points+1 per pixel: keys, x, y, code.

    Pixels are sent to square tiles with a border, so a tile is all a task needs at once, whatever the size of the
    image. Tiles arrive sorted and are worked on in stacks with array arithmetic. Missing pixels count as 0.
    """
    reach = math.ceil(radius) + 1
    samples = [bilinear_parts(dy, dx) for dy, dx in sample_points(points, radius)]
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    sent = pixels.select(*keys, "x", "y", "v", cells("x").alias("tx")).select("*", cells("y").alias("ty"))
    names = list(keys)
    group = [*names, "tx", "ty"]

    def stack_codes(frame: pd.DataFrame, gid: np.ndarray) -> pd.DataFrame:
        ly = (frame.y - frame.ty * tile).to_numpy() + reach
        lx = (frame.x - frame.tx * tile).to_numpy() + reach
        own = (ly >= reach) & (ly < tile + reach) & (lx >= reach) & (lx < tile + reach)
        grid = np.zeros((gid.max() + 1, tile + 2 * reach, tile + 2 * reach))
        grid[gid, ly, lx] = frame.v.to_numpy()
        at, rows, cols = gid[own], ly[own], lx[own]
        center = grid[at, rows, cols]
        bits = np.zeros((len(at), points), dtype=int)
        for k, parts in enumerate(samples):
            value = sum(w * grid[at, rows + dy, cols + dx] for dy, dx, w in parts)
            bits[:, k] = np.round(value, 6) >= center
        changes = (bits[:, 1:] != bits[:, :-1]).sum(axis=1)
        code = np.where(changes <= 2, bits.sum(axis=1), points + 1)
        kept = frame[own]
        return kept[names].assign(x=kept.x, y=kept.y, code=code)

    def encode(batches):
        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            gid = (frame[group] != frame[group].shift()).any(axis=1).cumsum().to_numpy() - 1
            rest = frame[gid == gid[-1]]
            for first in range(0, gid[-1], 128):
                part = (gid >= first) & (gid < min(first + 128, gid[-1]))
                yield stack_codes(frame[part], gid[part] - first)
        if rest is not None:
            yield stack_codes(rest, np.zeros(len(rest), dtype=int))

    schema = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", x int, y int, code int"
    return sent.repartition(*group).sortWithinPartitions(*group).mapInPandas(encode, schema)


def lbp_histogram(codes: DataFrame, keys: Sequence[str] = ("image_id",), points: int = 24) -> DataFrame:
    """Share of each pattern: one array of points + 2 numbers per blob; one aggregate of fixed width."""
    counts = codes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("code") == c).alias(f"_{c}") for c in range(points + 2)])
    return counts.select(*keys, F.array(*[F.col(f"_{c}") / (F.col("_n") + 1e-7) for c in range(points + 2)]).alias("lbp"))


def array_stats(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Standard deviation, mean and variance (population) of an array column."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    d = df.withColumn("_m", total(F.col(column)) / F.size(column))
    d = d.withColumn("_v", total(F.transform(column, lambda v: v * v)) / F.size(column) - F.col("_m") * F.col("_m"))
    d = d.withColumn("_v", F.greatest(F.col("_v"), F.lit(0.0)))
    return d.select(*[c for c in df.columns if c != column], F.sqrt("_v").alias(f"{prefix}_stddev"), F.col("_m").alias(f"{prefix}_mean"),
                    F.col("_v").alias(f"{prefix}_variance"))


def hog_cells(pixels: DataFrame, keys: Sequence[str] = ("image_id",), cell: int = 16, bins: int = 9) -> DataFrame:
    """Gradient strength per cell and direction: keys, row, col, bin, strength, and the grid size (rows, cols).

    pixels: keys, x, y, r, g, b. The band with the strongest gradient counts. Only whole cells are used.
    """
    packed = F.struct("r", "g", "b")
    near = neighbours(pixels, packed, {"w": (-1, 0), "e": (1, 0), "n": (0, -1), "s": (0, 1)}, keys)
    edge = lambda a, b, c: F.when(F.col(a).isNull() | F.col(b).isNull(), 0).otherwise(F.col(f"{b}.{c}") - F.col(f"{a}.{c}"))
    options = [F.struct((edge("w", "e", c) * edge("w", "e", c) + edge("n", "s", c) * edge("n", "s", c)).alias("q"), F.lit(-i).alias("i"),
                        edge("w", "e", c).alias("gx"), edge("n", "s", c).alias("gy")) for i, c in enumerate("rgb")]
    best = near.select(*keys, "x", "y", F.array_max(F.array(*options)).alias("o"))
    angle = F.pmod(F.degrees(F.atan2(F.col("o.gy").cast("double"), F.col("o.gx").cast("double"))), F.lit(180.0))
    place = F.least(F.floor(F.round(angle, 9) * bins / 180), F.lit(bins - 1)).cast("int")
    size = pixels.groupBy(*keys).agg(F.floor((F.max("y") + 1) / cell).cast("int").alias("rows"), F.floor((F.max("x") + 1) / cell).cast("int").alias("cols"))
    whole = (F.floor(F.col("x") / cell) < F.col("cols")) & (F.floor(F.col("y") / cell) < F.col("rows"))
    return best.join(size, list(keys)).filter(whole).groupBy(*keys, "rows", "cols", F.floor(F.col("y") / cell).cast("int").alias("row"), F.floor(F.col("x") / cell).cast("int").alias("col"),
                                      place.alias("bin")).agg((F.sum(F.sqrt(F.col("o.q").cast("double"))) / (cell * cell)).alias("strength"))


def hog_descriptor(cells: DataFrame, keys: Sequence[str] = ("image_id",), block: int = 2, bins: int = 9) -> DataFrame:
    """Block-normalised strengths: keys, cols, brow, bcol, row, col, bin, value (only non-zero entries are rows).

    Each cell is sent to the blocks that hold it; a block has at most block * block * bins entries.
    """
    spots = [F.struct((F.col("row") - a).alias("brow"), (F.col("col") - b).alias("bcol")) for a in range(block) for b in range(block)]
    sent = cells.select(*keys, "row", "col", "bin", "strength", "rows", "cols", F.inline(F.array(*spots)))
    sent = sent.filter((F.col("brow") >= 0) & (F.col("bcol") >= 0) & (F.col("brow") <= F.col("rows") - block) & (F.col("bcol") <= F.col("cols") - block))
    one = Window.partitionBy(*keys, "brow", "bcol")
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(one) + 1e-10)
    first = sent.withColumn("_a", F.least(F.col("strength") / norm("strength"), F.lit(0.2)))
    return first.withColumn("value", F.col("_a") / norm("_a")).select(*keys, "cols", "brow", "bcol", "row", "col", "bin", "value")


def hog_stats(descriptor: DataFrame, keys: Sequence[str] = ("image_id",), compat: bool = False, bins: int = 9, block: int = 2) -> DataFrame:
    """Standard deviation, mean and variance of the non-zero entries. ``compat`` takes their positions instead."""
    d = descriptor.filter("value <> 0")
    value = F.col("value")
    if compat:
        inside = ((F.col("row") - F.col("brow")) * block + F.col("col") - F.col("bcol")) * bins + F.col("bin")
        value = ((F.col("brow") * (F.col("cols") - block + 1) + F.col("bcol")) * (block * block * bins) + inside).cast("double")
    return d.groupBy(*keys).agg(F.stddev_pop(value).alias("hog_stddev"), F.avg(value).alias("hog_mean"), F.var_pop(value).alias("hog_variance"))


def band_levels(pixels: DataFrame, band: Column, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return pixels.select(*keys, "x", "y", band.alias("v"))
