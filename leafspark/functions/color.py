"""Colour-space conversions on integer bands 0..255. Every function maps Columns to Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour matrices and the white point of the conversions.
YIQ = ((0.299, 0.587, 0.114), (0.59590059, -0.27455667, -0.32134392), (0.21153661, -0.52273617, 0.31119955))
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def _dot(row, r, g, b) -> Column:
    return r * row[0] + g * row[1] + b * row[2]


def _byte(value: Column) -> Column:
    """Round half up and clip to 0..255."""
    return F.least(F.greatest(F.floor(value + 0.5), F.lit(0)), F.lit(255)).cast("int")


def _spread(r, g, b):
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return top, low, top - low


def yiq(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """YIQ on 0..1 floats."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    return {"yiq_y": _dot(YIQ[0], r, g, b), "yiq_i": _dot(YIQ[1], r, g, b), "yiq_q": _dot(YIQ[2], r, g, b)}


def yiq_bytes(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """YIQ rounded to bytes, I and Q moved by 128; values past one byte wrap."""
    shifted = (_dot(YIQ[0], r, g, b), _dot(YIQ[1], r, g, b) + 128, _dot(YIQ[2], r, g, b) + 128)
    names = ("yiq_y", "yiq_i", "yiq_q")
    return {n: F.pmod(F.bround(c, 0), F.lit(256)).cast("int") for n, c in zip(names, shifted)}


def hsi(r: Column, g: Column, b: Column, any_green: Column | None = None) -> dict[str, Column]:
    """HSI: hue in degrees. ``any_green`` says whether some pixel of the image has green over blue; where
    none has, the hue angle is mirrored."""
    total = r + g + b
    low = F.least(r, g, b).cast("double")
    low = F.when(low == 0, 0.00001).otherwise(low)
    divisor = F.when(total == 0, 0.00001).otherwise(total.cast("double"))
    root = F.sqrt(((r - g) * (r - g) + (r - b) * (g - b)).cast("double"))
    root = F.when(root == 0, 1.0).otherwise(root)
    cosine = ((r - g) + (r - b)) * 0.5 / root
    angle = F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    hue = angle if any_green is None else F.when(any_green, angle).otherwise(360 - angle)
    return {"hsi_hue": hue, "hsi_saturation": 1 - low * 3 / divisor, "hsi_intensity": total / 3.0}


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """HSV in 8-bit scale: hue 0..179 (half degrees), saturation and value 0..255."""
    top, _, spread = _spread(r, g, b)
    sixth = F.when(top == r, (g - b) * 30.0 / spread).when(top == g, (b - r) * 30.0 / spread + 60) \
        .otherwise((r - g) * 30.0 / spread + 120)
    hue = F.when(spread == 0, 0).otherwise(F.floor(sixth + 0.5))
    hue = F.when(hue < 0, hue + 180).otherwise(hue).cast("int")
    saturation = F.when(top == 0, 0).otherwise(F.floor(spread * 255.0 / top + 0.5)).cast("int")
    return {"hsv_hue": hue, "hsv_saturation": saturation, "value": top}


def hsv_unit(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """HSV with hue in degrees and saturation, value in 0..1."""
    top, _, spread = _spread(r, g, b)
    hue = F.when(spread == 0, 0.0).when(top == r, F.pmod((g - b) * 60.0 / spread, F.lit(360.0))) \
        .when(top == g, (b - r) * 60.0 / spread + 120).otherwise((r - g) * 60.0 / spread + 240)
    return {"h": hue, "s": F.when(top == 0, 0.0).otherwise(spread * 1.0 / top), "v": top / 255.0}


def grey(r: Column, g: Column, b: Column) -> Column:
    return _byte(_dot(YIQ[0], r, g, b))


def ycbcr(r: Column, g: Column, b: Column, compat: bool = False) -> dict[str, Column]:
    """YCbCr bytes. ``compat`` swaps the two chroma names, as code that reads the planes by position does."""
    y = grey(r, g, b)
    cr, cb = _byte((r - y) * 0.713 + 128), _byte((b - y) * 0.564 + 128)
    return {"ycbcr_y": y, "ycbcr_cb": cr if compat else cb, "ycbcr_cr": cb if compat else cr}


def yuv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    y = grey(r, g, b)
    return {"yuv_y": y, "yuv_u": _byte((b - y) * 0.492 + 128), "yuv_v": _byte((r - y) * 0.877 + 128)}


def cielab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIELAB bytes: L scaled to 0..255, a and b moved by 128."""
    def linear(c):
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def bend(t):
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x, y, z = (_dot(row, lr, lg, lb) / w for row, w in zip(XYZ, WHITE))
    light = F.when(y > 0.008856, F.cbrt(y) * 116 - 16).otherwise(y * 903.3)
    return {"cie_l": _byte(light * 255.0 / 100.0), "cie_a": _byte((bend(x) - bend(y)) * 500 + 128),
            "cie_b": _byte((bend(y) - bend(z)) * 200 + 128)}


def chromatic(r: Column, g: Column, b: Column, compat: bool = False) -> dict[str, Column]:
    """Share of each band in the sum. ``compat`` divides by sums of already changed bands, one after the other."""
    tiny = 1e-5
    red = r / (r + g + b + tiny)
    if not compat:
        return {"red": red, "green": g / (r + g + b + tiny), "blue": b / (r + g + b + tiny)}
    green = g / (red + g + b + tiny)
    return {"red": red, "green": green, "blue": b / (red + green + b + tiny)}


# Every band a factor can be computed on, by its factor prefix.
def all_bands(r: Column, g: Column, b: Column) -> dict[str, Column]:
    return {"greyscale": grey(r, g, b), "red": r, "green": g, "blue": b, **yiq(r, g, b), **hsv(r, g, b),
            **hsi(r, g, b), **ycbcr(r, g, b), **cielab(r, g, b)}
