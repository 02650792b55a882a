"""Vegetation indices per pixel, as Columns over the bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafspark.functions import color

# HSV colour ranges (name, low h, s, v, high h, s, v) in 8-bit scale.
COLOR_RANGES = [
    ("black", 0, 0, 0, 180, 255, 30), ("white", 0, 0, 231, 180, 18, 255), ("red1", 159, 50, 70, 180, 255, 255),
    ("red2", 0, 50, 70, 9, 255, 255), ("green", 36, 50, 70, 89, 255, 255), ("blue", 90, 90, 70, 128, 255, 255),
    ("yellow", 25, 50, 70, 35, 255, 255), ("purple", 129, 50, 70, 158, 255, 255),
    ("orange", 10, 50, 70, 24, 255, 255), ("gray", 0, 0, 40, 180, 18, 230)]
# Default threshold per index.
THRESHOLDS = {"ndi": 0, "exg": 200, "exr": 40, "cive": 0, "exgexr": 170, "ngrdi": 0, "veg": 0, "com1": 300, "mexg": 10,
              "com2": 40, "tgi": 0, "rgd": 0, "si": 0, "di": 0, "ycbcri": 0, "hv": 0}
FILL_VI = -13000


def _ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where the divisor is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def ndi(r, g, b) -> Column:
    return F.when(g + r == 0, 0.0).otherwise(((g - r) / (g + r) + 1) * 128)


def tgi(r, g, b) -> Column:
    return g - r * 0.52 - b * 0.59


def exg(r, g, b) -> Column:
    return (g * 2 - r - b).cast("double")


def exr(r, g, b) -> Column:
    return r * 1.3 - g


def exgr(r, g, b) -> Column:
    return exg(r, g, b) - exr(r, g, b)


def cive(r, g, b) -> Column:
    return r * 0.441 - g * 0.811 + b * 0.385 + 18.78745


def ngrdi(r, g, b) -> Column:
    return _ratio(g - r, g + r)


def veg(r, g, b) -> Column:
    return _ratio(g, F.pow(r, F.lit(0.667)) * F.pow(b, F.lit(1 - 0.667)))


def com1(r, g, b) -> Column:
    return exg(r, g, b) + cive(r, g, b) + exgr(r, g, b) + veg(r, g, b)


def mexg(r, g, b) -> Column:
    return g * 1.262 - r * 0.884 - b * 0.311


def com2(r, g, b) -> Column:
    return exg(r, g, b) * 0.36 + cive(r, g, b) * 0.47 + veg(r, g, b) * 0.17


def _hsv_box(hsv: dict[str, Column], low: tuple, high: tuple) -> Column:
    bands = (hsv["hsv_hue"], hsv["hsv_saturation"], hsv["value"])
    inside = [band.between(lo, hi) for band, lo, hi in zip(bands, low, high)]
    return inside[0] & inside[1] & inside[2]


def si(r, g, b) -> Column:
    """Blue spray: 255 within 20 of the blue hue."""
    return F.when(_hsv_box(color.hsv(r, g, b), (100, 130, 130), (140, 255, 255)), 255).otherwise(0)


def rgd(r, g, b) -> Column:
    """Red or green dots: 255 on a hit."""
    hsv = color.hsv(r, g, b)
    green = _hsv_box(hsv, (40, 100, 100), (80, 255, 255))
    red = _hsv_box(hsv, (0, 100, 20), (0, 255, 255)) | _hsv_box(hsv, (160, 100, 20), (179, 255, 255))
    return F.when(green | red, 255).otherwise(0)


def color_names(r, g, b) -> Column:
    """All named colour ranges that hold the pixel; the range table is ten literals, so no join is needed."""
    hsv = color.hsv(r, g, b)
    hits = [F.when(_hsv_box(hsv, box[:3], box[3:]), F.lit(name)) for name, *box in COLOR_RANGES]
    return F.array_compact(F.array(*hits))


def lid_mask(r, g, b) -> Column:
    """Blue bucket lid: 255 on a hit."""
    blue = next(box for name, *box in COLOR_RANGES if name == "blue")
    return F.when(_hsv_box(color.hsv(r, g, b), blue[:3], blue[3:]), 255).otherwise(0)


def pipes(r, g, b, compat: bool = False) -> Column:
    planes = color.ycbcr(r, g, b, compat)
    return planes["ycbcr_cb"] <= planes["ycbcr_cr"]


def yi(r, g, b) -> Column:
    q = color.yiq(r, g, b)["yiq_q"]
    return F.when(q < 0.04, q).otherwise(0.0)


def hi(r, g, b) -> Column:
    bands = color.hsi(r, g, b)
    h, s, i = bands["hsi_hue"], bands["hsi_saturation"], bands["hsi_intensity"]
    h = F.when((h >= 190) | (h <= 55), 0.0).otherwise(h)
    return h + F.when(s <= 0.45, 0.0).otherwise(s) + F.when(i >= 50, 0.0).otherwise(i)


def hv_gates(r, g, b) -> dict[str, Column]:
    """Gated hue and saturation of the HV index; the value band needs image statistics."""
    bands = color.hsv(r, g, b)
    h, s = bands["hsv_hue"], bands["hsv_saturation"]
    return {"h": F.when((h >= 50) | (h <= 30), 0).otherwise(h), "s": F.when(s <= 20, 0).otherwise(s), "v": bands["value"]}


def ci(r, g, b) -> Column:
    lab = color.cielab(r, g, b)
    gap = (lab["cie_b"] - lab["cie_a"]).cast("double")
    return F.when(gap < 30, 0.0).otherwise(gap)


def ycbcri(r, g, b, compat: bool = False) -> Column:
    """log2 of red difference times blue difference, 890 and more to 0; a zero red difference gives 0."""
    planes = color.ycbcr(r, g, b, compat)
    cr, cb = planes["ycbcr_cr"], planes["ycbcr_cb"]
    value = F.when(cr == 0, 0.0).otherwise(F.log2(F.abs(cr).cast("double")) * cb)
    return F.when(value >= 890, 0.0).otherwise(value)


def dgci(r, g, b) -> Column:
    c = color.hsv_unit(r, g, b)
    return ((c["h"] - 60) / 60 + (1 - c["s"]) + (1 - c["v"])) / 3


def dgci_hexcone(r, g, b) -> Column:
    """The hand-written hexcone variant: a small lift of the maximum, products in two branches."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    peak, low = F.greatest(r, g, b), F.least(r, g, b)
    top = peak + 0.00001
    spread = top - low
    h = F.when(peak == r, (g - b) / spread * 60).when(peak == g, ((b - r) * spread + 2.0) * 60) \
        .otherwise(((r - g) * spread + 4.0) * 60)
    return ((h - 60) / 60 + (1 - spread / top) + (1 - top)) / 3


def _scaled(value: Column, fallback: Column) -> Column:
    """Whole ten-thousandths of a value inside -1..1."""
    whole = F.when(value >= 0, F.floor(value * 10000)).otherwise(F.ceil(value * 10000)).cast("int")
    return F.when((value < -1) | (value > 1) | value.isNull(), fallback).otherwise(whole)


def ndvi(red, nir, fill: int = FILL_VI) -> Column:
    return _scaled(F.try_divide(nir - red, nir + red), F.lit(fill))


def evi2(red, nir, fill: int = FILL_VI) -> Column:
    return _scaled(F.try_divide((nir - red) * 2.5, nir + red * 2.4 + 1.0), F.lit(fill))


def evi(red, nir, blue, fill: int = FILL_VI) -> Column:
    """EVI; falls back to EVI2 where blue is out of range or the bands are not ordered."""
    other = evi2(red, nir, fill)
    value = F.try_divide(nir - red, nir + red * 6.0 - blue * 7.5 + 1.0) * 2.5
    return F.when((blue > 0) & (blue < 1) & (nir > red) & (red > blue), _scaled(value, other)).otherwise(other)


# Indices that need nothing but the pixel. DI and HV need image statistics, see operators.images.
PIXEL_INDICES: dict[str, Callable[..., Column]] = {
    "ndi": ndi, "tgi": tgi, "ngrdi": ngrdi, "exgexr": exgr, "exg": exg, "exr": exr, "cive": cive, "veg": veg,
    "com1": com1, "mexg": mexg, "com2": com2, "rgd": rgd, "si": si, "ycbcri": ycbcri}


def index(name: str, r, g, b) -> Column:
    """The index by name."""
    try:
        return PIXEL_INDICES[name.lower()](r, g, b)
    except KeyError:
        raise ValueError(f"unknown pixel index {name!r}; known: {sorted(PIXEL_INDICES)}") from None
