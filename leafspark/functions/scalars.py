"""Small scalar helpers: positions, sizes, names and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensor pixel sizes in micrometres by camera model and pixel count.
PIXEL_SIZES = [("iPhone 14 Pro", 4032 * 3024, 2.44), ("iPhone 14 Pro", 6048 * 8064, 1.22), ("FC3411", 5464 * 3640, 2.4)]
EARTH_RADIUS_M = 6371008.8


def to_dms(degrees: Column) -> dict[str, Column]:
    """Sign flag, whole degrees, whole minutes and seconds."""
    size = F.abs(degrees)
    whole = F.floor(size)
    minutes = (size - whole) * 60
    return {"neg": degrees < 0, "d": whole.cast("double"), "m": F.floor(minutes).cast("double"),
            "s": (minutes - F.floor(minutes)) * 60}


def from_dms(d: Column, m: Column, s: Column, ref: Column, compat: bool = False) -> Column:
    """Decimal degrees; west and south are negative. ``compat`` negates east and south instead."""
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("E" if compat else "W", "S"), -value).otherwise(value)


def agl(altitude: Column, base: Column | float) -> Column:
    return altitude - base


def nearest_bucket(value: Column, buckets: Sequence[float], compat: bool = False) -> Column:
    """The bucket nearest to the value, the first one on a tie. ``compat`` keeps the distance-below-bucket test."""
    if compat:
        chosen = F.lit(float(buckets[0]))
        for bucket in buckets:
            chosen = F.when(F.abs(F.lit(float(bucket)) - value) < chosen, float(bucket)).otherwise(chosen)
        return chosen
    pairs = [F.struct(F.abs(value - float(b)).alias("gap"), F.lit(i).alias("i"), F.lit(float(b)).alias("bucket"))
             for i, b in enumerate(buckets)]
    return F.array_min(F.array(*pairs))["bucket"]


def pixel_size(model: Column, pixels: Column) -> Column:
    """Pixel size of a known camera, 0 otherwise. Three literals: no join needed."""
    size = F.lit(0.0)
    for name, count, value in PIXEL_SIZES:
        size = F.when((model == name) & (pixels == count), value).otherwise(size)
    return size


def flight_height(width_px: Column, pixel_um: Column, focal: Column, target_mm: float) -> dict[str, Column]:
    """View angle and height from a target of known size."""
    tangent = width_px * pixel_um / 1000 / 2 / focal
    return {"angle": F.degrees(F.atan(tangent)), "height": F.try_divide(F.lit(target_mm / 2), tangent)}


def mm_between(x1: Column, x2: Column, mm_per_pixel: float) -> Column:
    """Whole millimetres along x, cut towards zero."""
    return ((x2 - x1) * mm_per_pixel).cast("int")


def magnitude(x: Column) -> Column:
    """Decimal order of magnitude; null for 0."""
    return F.when(x != 0, F.floor(F.log10(F.abs(x)))).cast("int")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) \
        * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def run_name(technique: Column, correction: Column) -> Column:
    return F.concat_ws("_", technique, correction)


def caption(template: str, technique: Column) -> Column:
    return F.replace(F.lit(template), F.lit("%T"), technique)


def grid_cell(cx: Column, cy: Column, height: int, size: int) -> dict[str, Column]:
    """Row counted from the bottom edge, starting at 1, and column."""
    return {"row": F.floor((F.lit(height) - cy) / size).cast("int") + 1, "col": F.floor(cx / size).cast("int")}


def grid_corner(row: Column, col: Column, height: int, size: int) -> dict[str, Column]:
    return {"left": col * size, "top": F.lit(height) - row * size}


def emitter_line(side: Column, tier: Column, position: Column) -> Column:
    """Output line of an emitter: three per tier, the right side follows the left; null when unknown."""
    number = (tier - 1) * 3 + (position - 1) + F.when(side == "RIGHT", 12).otherwise(0)
    valid = side.isin("LEFT", "RIGHT") & tier.between(1, 4) & position.between(1, 3)
    return F.when(valid, F.concat(F.lit("line"), number.cast("string")))


def line_parts(line: Column) -> dict[str, Column]:
    parts = F.split(line, "/")
    return {"module": parts[0], "port": parts[1], "channel": parts[2]}


def lut_class(value: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Position of the first range that holds the value, -1 if none. The table is a small literal list."""
    out = F.lit(-1)
    for i in reversed(range(len(table))):
        out = F.when(value.between(*table[i]), i).otherwise(out)
    return out


def bag_cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two bags of words."""
    count = lambda bag, term: F.size(F.filter(bag, lambda t: t == term)).cast("double")
    dot = F.aggregate(F.array_distinct(left), F.lit(0.0), lambda acc, t: acc + count(left, t) * count(right, t))
    norm = lambda bag: F.sqrt(F.aggregate(F.array_distinct(bag), F.lit(0.0), lambda acc, t: acc + count(bag, t) * count(bag, t)))
    return F.try_divide(dot, norm(left) * norm(right))
