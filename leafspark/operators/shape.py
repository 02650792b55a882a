"""Shape factors of blob contours.

A contour is one array of (x, y) structs per blob, in order, so every factor is a Column over that
array: no shuffle, no self join. The hull, lengths, areas and curvatures run as Arrow-batched functions, on the points
of a batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspark.operators.grouped import with_group_stats

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def _at(points: Column, i: Column) -> Column:
    """The point at position i, counted round the contour."""
    return F.element_at(points, F.pmod(i, F.size(points)) + 1)


class _Flat:
    """The points of a batch of contours one after the other, as doubles (nan where a coordinate is null)."""

    def __init__(self, contours: pa.Array):
        self.none = contours.is_null().to_numpy(zero_copy_only=False)
        self.sizes = contours.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = (self.ends - self.sizes)[self.owner]
        self.x, self.y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in contours.flatten().flatten())

    def away(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """For every point the one so many steps on, counted round its contour."""
        at = self.first + (np.arange(len(self.x)) - self.first + steps) % self.sizes[self.owner]
        return self.x[at], self.y[at]

    def sums(self, values: np.ndarray) -> pa.Array:
        """The sum of a contour's values, in order; null where one is nan."""
        total = np.bincount(self.owner, weights=values, minlength=len(self.sizes))
        return pa.array(total, mask=self.none | np.isnan(total))


@F.arrow_udf(T.DoubleType())
def _lengths(contours: pa.Array) -> pa.Array:
    flat = _Flat(contours)
    x, y = flat.away(1)
    return flat.sums(np.sqrt((x - flat.x) ** 2 + (y - flat.y) ** 2))


@F.arrow_udf(T.DoubleType())
def _areas(contours: pa.Array) -> pa.Array:
    flat = _Flat(contours)
    x, y = flat.away(1)
    return flat.sums(flat.x * y - x * flat.y)


def perimeter(points: Column) -> Column:
    return _lengths(points)


def area(points: Column) -> Column:
    """Polygon area through the points."""
    return F.abs(_areas(points)) / 2


def bounds(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return {"x": x, "y": y, "w": F.array_max(xs) - x + 1, "h": F.array_max(ys) - y + 1}


def _moments(points: Column):
    """Count and centered second sums, from whole-number sums gathered in one pass."""
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("sx", "sy", "xx", "yy", "xy")])
    add = lambda s, p: F.struct(
        (s["sx"] + p["x"]).alias("sx"), (s["sy"] + p["y"]).alias("sy"), (s["xx"] + p["x"] * p["x"]).alias("xx"),
        (s["yy"] + p["y"] * p["y"]).alias("yy"), (s["xy"] + p["x"] * p["y"]).alias("xy"))
    sums = F.aggregate(points, start, add)
    n = F.size(points)
    return n, sums["xx"] - sums["sx"] * sums["sx"] / n, sums["yy"] - sums["sy"] * sums["sy"] / n, sums["xy"] - sums["sx"] * sums["sy"] / n


def _eigen(a: Column, d: Column, c: Column) -> tuple[Column, Column]:
    half, root = (a + d) / 2, F.sqrt(F.pow((a - d) / 2, F.lit(2)) + c * c)
    return half + root, half - root


def length_width_ratio(points: Column) -> Column:
    """Ratio of the eigenvalues of the spread matrix (population variances, sample covariance)."""
    n, sxx, syy, sxy = _moments(points)
    top, low = _eigen(sxx / n, syy / n, F.try_divide(sxy, n - 1))  # null for a single point
    return F.try_divide(top, low)


def eccentricity(points: Column) -> Column:
    """Minor over major axis of the ellipse with the same second moments."""
    n, sxx, syy, sxy = _moments(points)
    top, low = _eigen(sxx / n, syy / n, sxy / n)
    return F.when(top == 0, 0.0).otherwise(F.sqrt(F.greatest(low, F.lit(0.0)) / top))


def shape_factors(contours: DataFrame, image_width: int) -> DataFrame:
    """Perimeter, area and the factors built on them; two factors are 0 for blobs at the image edge."""
    p = F.col("contour")
    df = contours.withColumns({"perimeter": perimeter(p), "area": area(p), "_box": F.struct(*[c.alias(n) for n, c in bounds(p).items()]),
                               "_ratio": length_width_ratio(p), "eccentricity": eccentricity(p)})
    edge = (df["_box.x"] == 0) | (df["_box.x"] + df["_box.w"] >= image_width)
    return df.select(
        "image_id", "blob_id", "perimeter", "area",
        F.when(edge, 0.0).otherwise(F.try_divide(df.perimeter, F.sqrt(df.area) * 4)).alias("shape_index"),
        F.when(edge, 0.0).otherwise(df["_ratio"]).alias("lw_ratio"),
        F.try_divide(df.area * (4 * math.pi), df.perimeter * df.perimeter).alias("compactness"),
        (df["_box.w"] / df["_box.h"]).alias("elongation"), "eccentricity")


def _hull_arrays(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Monotone chains of many contours at once: padded rows of sorted points to (x, y, count) of hull corners."""
    n, most = xs.shape
    at = np.arange(n)
    hx, hy = np.zeros((n, 2 * most + 2), dtype=xs.dtype), np.zeros((n, 2 * most + 2), dtype=xs.dtype)
    count, floor = np.zeros(n, dtype=int), np.ones(n, dtype=int)
    for sweep in (0, 1):
        for step in range(most):
            place = step if sweep == 0 else sizes - 1 - step
            live = (step < sizes) if sweep == 0 else (place >= 0) & (step > 0)
            px, py = xs[at, np.maximum(place, 0)], ys[at, np.maximum(place, 0)]
            while True:
                open_ = live & (count > floor)
                a, b = np.maximum(count - 2, 0), np.maximum(count - 1, 0)
                turn = (hx[at, b] - hx[at, a]) * (py - hy[at, a]) - (hy[at, b] - hy[at, a]) * (px - hx[at, a])
                back = open_ & (turn <= 0)
                if not back.any():
                    break
                count[back] -= 1
            rows = at[live]
            hx[rows, count[live]], hy[rows, count[live]] = px[live], py[live]
            count[live] += 1
        floor = count.copy()
    return hx, hy, np.where(sizes > 1, count - 1, count)


HULL = T.StructType([T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("y", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(HULL)
def _hull(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    lengths = xs.map(len).to_numpy()
    owner = np.repeat(np.arange(len(xs)), lengths)
    points = np.unique(np.stack([owner, np.concatenate(xs.to_list()), np.concatenate(ys.to_list())], axis=1).astype(np.int64), axis=0)
    sizes = np.bincount(points[:, 0], minlength=len(xs))
    first = np.cumsum(sizes) - sizes
    px, py = (np.zeros((len(xs), max(int(sizes.max()), 1)), dtype=np.int64) for _ in "xy")
    column = np.arange(len(points)) - first[points[:, 0]]
    px[points[:, 0], column], py[points[:, 0], column] = points[:, 1], points[:, 2]
    hx, hy, count = _hull_arrays(px, py, sizes)
    return pd.DataFrame({"x": [r[:c] for r, c in zip(hx, count)], "y": [r[:c] for r, c in zip(hy, count)]})


def convex_hull(points: Column) -> Column:
    """Convex hull of a contour, corners only; many contours are walked together in arrays."""
    parts = _hull(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))
    return F.zip_with(parts["x"], parts["y"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def hull_factors(contours: DataFrame) -> DataFrame:
    p, h = F.col("contour"), F.col("hull")
    df = contours.withColumn("_xy", _hull(F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])))
    df = df.withColumn("hull", F.zip_with("_xy.x", "_xy.y", lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    df = df.withColumns({"area": area(p), "perimeter": perimeter(p), "hull_perimeter": perimeter(h), "hull_area": area(h)})
    return df.select("image_id", "blob_id", "hull_perimeter", "hull_area",
                     F.try_divide(df.area * (4 * math.pi), df.hull_perimeter * df.hull_perimeter).alias("roundness"),
                     F.try_divide(df.hull_perimeter, df.perimeter).alias("convexity"),
                     F.try_divide(df.area, df.hull_area).alias("solidity"))


# Chain code by row (next point lower, level, higher) and column (left, same, right).
CHAIN_CODES = ((3, 2, 1), (4, 99, 0), (5, 6, 7))


def chain_code(points: Column) -> Column:
    """Direction 0..7 from each point to the next; an open chain."""
    def code(p, q):
        row = F.when(p["y"] < q["y"], 0).when(p["y"] > q["y"], 2).otherwise(1)
        col = F.when(p["x"] > q["x"], 0).when(p["x"] < q["x"], 2).otherwise(1)
        flat = F.array(*[F.lit(c) for line in CHAIN_CODES for c in line])
        return F.element_at(flat, row * 3 + col + 1)
    starts = F.slice(points, F.lit(1), F.size(points) - 1)
    return F.transform(starts, lambda p, i: code(p, _at(points, i + 1)))


def _slope(p, q) -> Column:
    """atan of dx over dy, 0 on a level line."""
    return F.when(p["y"] == q["y"], 0.0).otherwise(F.atan((p["x"] - q["x"]) / (p["y"] - q["y"])))


def _steps(points: Column, first: int, margin: int, stride: int) -> Column:
    """Positions first, first + stride, ... below size - margin; empty when there are none."""
    stop = F.size(points) - margin - 1
    return F.when(stop >= first, F.sequence(F.lit(first), F.greatest(stop, F.lit(first)), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def k_slope(points: Column, k: int = 6) -> Column:
    if k % 2:
        raise ValueError("k must be even")
    half = k // 2
    return F.transform(_steps(points, half - 1, half + 1, k), lambda i: _slope(_at(points, i + half), _at(points, i - half)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _curvatures(contours: pa.Array, k: pa.Array) -> pa.Array:
    flat, k = _Flat(contours), k[0].as_py() if len(k) else 1
    (ax, ay), (bx, by) = flat.away(k), flat.away(-k)
    f1x, f1y = (ax - bx) / k, (ay - by) / k
    f2x, f2y = (ax - flat.x * 2 + bx) / (k * k), (ay - flat.y * 2 + by) / (k * k)
    power, turn = f1x * f1x + f1y * f1y, f2y * f1x - f2x * f1y
    curve = np.sqrt(turn * turn * 4 / (power * power * power + 1e-11 + 1e-12))
    return pa.ListArray.from_arrays(pa.array(np.append(0, flat.ends), pa.int32()), pa.array(curve, mask=np.isnan(curve)), mask=pa.array(flat.none))


def k_curvature(points: Column, k: int = 6) -> Column:
    """Curvature at every point from the points k before and k after."""
    return _curvatures(points, F.lit(k))


def k_curvature_approximate(points: Column, k: int = 6) -> Column:
    return F.transform(_steps(points, k - 1, k + 1, k), lambda i: _slope(_at(points, i - k), _at(points, i))
                       - _slope(_at(points, i), _at(points, i + k)))


def bending(contours: DataFrame, k: int = 6) -> DataFrame:
    """Mean squared and mean absolute curvature per blob."""
    df = contours.withColumn("_curve", k_curvature(F.col("contour"), k))
    return df.select("image_id", "blob_id", _mean(F.transform("_curve", lambda c: c * c)).alias("bending"),
                     _mean(F.transform("_curve", F.abs)).alias("abscurvature"))


def radial(contours: DataFrame) -> DataFrame:
    """Statistics of the distances from the mean point, scaled by the largest."""
    p = F.col("contour")
    mean = lambda c: F.floor(_mean(F.transform(p, lambda q: q[c])))
    df = contours.withColumn("_c", F.struct(mean("x").alias("x"), mean("y").alias("y")))
    df = df.withColumn("_d", F.transform(p, lambda q: F.sqrt(F.pow(q["x"] - F.col("_c.x"), F.lit(2)) + F.pow(q["y"] - F.col("_c.y"), F.lit(2)))))
    df = df.withColumn("_n", F.transform("_d", lambda d: F.try_divide(d, F.array_max("_d"))))
    df = df.withColumn("radial_avg", _mean(F.col("_n")))
    over = F.filter("_n", lambda d: F.round(d, 12) > F.round("radial_avg", 12))  # equal distances are not over their mean
    return df.select("image_id", "blob_id", F.array_max("_d").alias("radial_max"), "radial_avg",
                     _mean(F.transform("_n", lambda d: F.pow(d - F.col("radial_avg"), F.lit(2)))).alias("radial_var"),
                     (F.size(over) / F.size("_n")).alias("radial_crossings_pct"))


def blob_geometry(pixels: DataFrame, keys=("image_id", "blob_id"), more=()) -> DataFrame:
    """Area, box, center and size ratio of blobs given as pixel rows; ``more`` are further aggregates of a blob's pixels."""
    blobs = pixels.groupBy(*keys).agg(
        *more,
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.floor(F.avg("x")).cast("int").alias("cx"), F.floor(F.avg("y")).cast("int").alias("cy"))
    b = with_group_stats(blobs, [keys[0]], _largest=F.max("area"))
    return b.select(*keys, *[c for c in blobs.columns if c not in keys], (b.area / b["_largest"]).alias("size_ratio"))


def blob_bands(pixels: DataFrame, bands: dict[str, Column], keys=("image_id", "blob_id")) -> DataFrame:
    """Mean and standard deviation of bands per blob; zeros do not count."""
    return pixels.groupBy(*keys).agg(*band_aggregates(bands))


def band_aggregates(bands: dict[str, Column]) -> list[Column]:
    aggregates = []
    for name, band in bands.items():
        used = F.when(band != 0, band)
        aggregates += [F.avg(used).alias(f"{name}_mean"), F.stddev_pop(used).alias(f"{name}_stddev")]
    return aggregates



def reduce_blobs(df: DataFrame, keys, value: str, parts, finish) -> DataFrame:
    """A caller-supplied reduction of a blob band that splits into sums: keys, reduced.

    ``parts`` maps a numpy array of values to a list of numbers that add up over pieces of a blob (count, sum, sum of
    squares and the like); ``finish`` maps the added numbers to the result. Pieces are reduced where they lie and only
    the numbers are shuffled, so a blob of any size is fine. Built-in aggregates need none of this.
    """
    names = list(keys)

    def partial(batches):
        for frame in batches:
            if len(frame):
                sums = [(*(k if isinstance(k, tuple) else (k,)), [float(v) for v in parts(g[value].to_numpy())]) for k, g in frame.groupby(names)]
                yield pd.DataFrame(sums, columns=[*names, "parts"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names) + ", parts array<double>"
    pieces = df.select(*names, value).mapInPandas(partial, schema)
    added = pieces.select(*names, F.posexplode("parts").alias("i", "v")).groupBy(*names, "i").agg(F.sum("v").alias("v"))
    packed = added.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return packed.select(*names, finish(F.transform("p", lambda e: e["v"])).alias("reduced"))
