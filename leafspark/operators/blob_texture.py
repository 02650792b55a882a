"""All texture factors of blobs in one pass over bordered tiles.

A tile computes, for each blob that it holds a part of and for every band, the sums that the co-occurrence properties
need, the counts of binary patterns and the gradient strength by cell and direction. Only such numbers leave the task,
one row a blob and tile. Blobs that lie in one tile are done there; the numbers of the others are added up first. Only
pixels of the blob itself count as neighbours, as for the operators of :mod:`texture` with the blob among their keys.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.functions import color
from leafspark.functions.catalog_of_factors import BANDS, LBP_BINS
from leafspark.operators import texture, tiles
from leafspark.session import cut_lineage

NAMES = [band for bands in BANDS.values() for band in bands]
#: Bands that are no bytes: for co-occurrence they become two levels, the blob's highest value and the rest.
FLOATS = [*BANDS["YIQ"], *BANDS["HSI"]]
#: The angles that are counted; 180 has the transposed counts of 0 and the same properties, so 0 weighs twice.
COUNTED = {"0": 2, "45": 1, "90": 1, "135": 1}
SUMS = ["t", "c", "d", "h", "si", "sj", "sii", "sjj", "sij", "nn"]
GLCM_SIZE, LBP_SIZE = len(NAMES) * len(COUNTED) * len(SUMS), len(NAMES) * LBP_BINS
CELL, BINS = 16, 9
#: Border of a tile: the radius of the patterns and the pixel after it.
REACH = 9
#: Cells of a stack: 19 doubles each.
STACK_CELLS = 100_000
#: Split blobs that are finished at once: 1,254 doubles each.
FINISHED = 1_000


def band_columns(r: Column, g: Column, b: Column, any_green: Column) -> dict[str, Column]:
    """The bands of the factor catalogue, in its order."""
    found = color.all_bands(r, g, b) | color.hsi(r, g, b, any_green)
    return {name: found[name] for name in NAMES}


def byte_columns(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The bands that are whole numbers and follow from a pixel alone, but for its own three."""
    found = color.all_bands(r, g, b)
    return {n: found[n] for name in ("GREYSCALE", "HSV", "YCBCR", "CIELAB") for n in BANDS[name]}


def float_ranges(bands: dict[str, Column]) -> list[Column]:
    """Aggregates: the least and the largest value of each float band."""
    return [f(bands[n]).alias(f"_{k}_{n}") for n in FLOATS for k, f in (("lo", F.min), ("hi", F.max))]


def peaks(bands: dict[str, Column]) -> Column:
    """Bit k is the level of float band k, given its range."""
    level = lambda n: F.when(F.col(f"_hi_{n}") != F.col(f"_lo_{n}"), F.floor((bands[n] - F.col(f"_lo_{n}")) / (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).cast("int")).otherwise(0)
    return sum((level(n) * (1 << k) for k, n in enumerate(FLOATS)), F.lit(0))


def _glcm(stack, cell, group, groups, blob, levels, split) -> tuple[np.ndarray, list]:
    """[group, band, angle, sum] and, for groups of split blobs, (group, slot, codes, counts)."""
    bands = len(NAMES)
    out = np.zeros((groups, bands, len(COUNTED), len(SUMS)))
    codes: list[tuple] = []
    for a, angle in enumerate(COUNTED):
        dx, dy = texture.ANGLES[angle]
        there = cell + dy * stack.shape[2] + dx
        pair = blob[there] == blob[cell]
        p, q = cell[pair], there[pair]
        if not len(p):
            continue
        place = group[pair][:, None] * bands + np.arange(bands)
        keys, counts = np.unique(place << 16 | levels[p].astype(np.int64) << 8 | levels[q], return_counts=True)
        of, i, j = keys >> 16, keys >> 8 & 255, keys & 255
        gap = i - j
        for s, w in enumerate((1, gap * gap, np.abs(gap), 1 / (1 + gap * gap), i, j, i * i, j * j, i * j, counts)):
            out[:, :, a, s] = np.bincount(of, counts * w, groups * bands).reshape(groups, bands)
        many = split[of // bands]
        if many.any():
            codes.append((of[many] // bands, of[many] % bands * len(COUNTED) + a, keys[many] & 0xFFFF, counts[many]))
    return out, codes


def _patterns(stack, cell, group, groups, blob, values, points: int = 24, radius: float = 8.0) -> np.ndarray:
    """[group, band, code]: uniform pattern counts; pixels outside the blob are 0."""
    center, mine = values[cell], blob[cell]
    alone = center <= 0  # the bit of a sample that lies outside the blob
    before, changes, total = None, np.zeros(center.shape, np.int8), np.zeros(center.shape, np.int8)
    for sample in texture.sample_points(points, radius):
        parts = [(cell + dy * stack.shape[2] + dx, w) for dy, dx, w in texture.bilinear_parts(*sample)]
        same = [blob[there] == mine for there, _ in parts]
        some = np.flatnonzero(np.logical_or.reduce(same))
        value = np.zeros((len(some), len(NAMES)))
        for (there, w), one in zip(parts, same):
            value += w * (values[there[some]] * one[some, None])
        bit = alone.copy()
        bit[some] = np.round(value, 6) >= center[some]
        total += bit
        if before is not None:
            changes += bit != before
        before = bit
    code = np.where(changes <= 2, total, points + 1).astype(np.int64)
    slot = (group[:, None] * len(NAMES) + np.arange(len(NAMES))) * LBP_BINS + code
    return np.bincount(slot.ravel(), minlength=groups * LBP_SIZE).reshape(groups, LBP_SIZE)


def _gradients(stack, cell, frame, group, blob, rgb) -> pd.DataFrame:
    """group, row, col, bin, strength: summed over the pixels of each cell of the blob's box."""
    width = stack.shape[2]

    def difference(low, high):
        both = (blob[cell + low] == blob[cell]) & (blob[cell + high] == blob[cell])
        return np.where(both[:, None], rgb[cell + high] - rgb[cell + low], 0)
    gx, gy = difference(-1, 1), difference(-width, width)
    power = gx * gx + gy * gy
    best = power.argmax(1)
    pick = np.arange(len(cell)), best
    angle = np.mod(np.degrees(np.arctan2(gy[pick].astype(float), gx[pick].astype(float))), 180)
    place = np.minimum(np.floor(np.round(angle, 9) * BINS / 180), BINS - 1).astype(int)
    sums = pd.DataFrame({"group": group, "row": (frame["y"] - frame["y0"]).to_numpy() // CELL, "col": (frame["x"] - frame["x0"]).to_numpy() // CELL,
                         "bin": place, "strength": np.sqrt(power[pick].astype(float))})
    return sums.groupby(["group", "row", "col", "bin"], as_index=False)["strength"].sum()


def _work(stack: tiles.Stack):
    own = stack.own
    if not own.any():
        return
    every = np.ravel_multi_index((stack.at, stack.row, stack.col), stack.shape)
    cells = int(np.prod(stack.shape))
    blob = np.full(cells, -1, np.int64)
    blob[every] = stack.frame["blob_id"].to_numpy()
    source = stack.frame[NAMES].to_numpy(np.float64)
    values = np.zeros((cells, len(NAMES)))
    values[every] = source
    level = source.astype(np.int64)
    bits = stack.frame["peaks"].to_numpy()
    for k, name in enumerate(FLOATS):
        level[:, NAMES.index(name)] = bits >> k & 1
    levels = np.zeros((cells, len(NAMES)), np.uint8)
    levels[every] = level
    rgb = np.zeros((cells, 3), np.int32)
    rgb[every] = stack.frame[["r", "g", "b"]].to_numpy()
    frame, cell = stack.frame[own], every[own]
    ids, number = np.unique(blob[cell], return_inverse=True)
    pairs, first, group = np.unique(stack.at[own] * len(ids) + number, return_index=True, return_inverse=True)
    groups = len(pairs)
    split = frame["split"].to_numpy(bool)[first]
    glcm, codes = _glcm(stack, cell, group, groups, blob, levels, split)
    lbp = _patterns(stack, cell, group, groups, blob, values)
    hog = _gradients(stack, cell, frame, group, blob, rgb)
    numbers = np.concatenate((glcm.reshape(groups, -1), lbp), axis=1)
    done = _measured(numbers[~split])
    many = [np.concatenate(c) for c in zip(*codes)] if codes else [np.zeros(0, np.int64)] * 4
    order = np.argsort(many[0], kind="stable")
    bounds = np.searchsorted(many[0][order], np.arange(groups + 1))
    ends = np.searchsorted(hog["group"].to_numpy(), np.arange(groups + 1))
    cut = lambda values, at: [values[a:b] for a, b in zip(at[:-1], at[1:])]

    def filled(rows, which):
        out = np.full(groups, None, dtype=object)
        out[which] = _listed(rows)
        return out
    yield pd.DataFrame({
        "image_id": stack.heads["image_id"].to_numpy()[stack.at[own][first]], "blob_id": ids[number[first]], "split": split,
        "numbers": filled(numbers[split], split), **{n: filled(rows, ~split) for n, rows in done.items()},
        **{n: cut(c[order], bounds) for n, c in zip(("slots", "codes", "counts"), many[1:])},
        **{n: cut(hog[n].to_numpy(), ends) for n in ("row", "col", "bin", "strength")}})


def _properties(sums: np.ndarray) -> np.ndarray:
    """[blob, band, property] in the order of :data:`texture.PROPERTIES`, averaged over the angles."""
    t, c, d, h, si, sj, sii, sjj, sij, nn = (sums[..., k] for k in range(len(SUMS)))
    with np.errstate(divide="ignore", invalid="ignore"):
        asm = nn / (t * t)
        spread = np.sqrt(sii * t - si * si) * np.sqrt(sjj * t - sj * sj)
        correlation = np.where(spread == 0, 1.0, (sij * t - si * sj) / spread)
        found = np.stack([np.sqrt(asm), c / t, d / t, h / t, asm, correlation], axis=-1)  # a blob without a pair at an angle has none of it
    weight = np.array(list(COUNTED.values()), float)[:, None] * (t > 0)[..., None]
    with np.errstate(invalid="ignore"):
        return np.nansum(np.where(weight > 0, found * weight, 0), axis=2) / weight.sum(2)


def _listed(rows: np.ndarray) -> np.ndarray:
    """The rows of a matrix as a vector of arrays."""
    out = np.empty(len(rows), dtype=object)
    out[:] = list(rows)
    return out


def _measured(numbers: np.ndarray) -> dict[str, np.ndarray]:
    """The factors of blobs, a row each, from their numbers; nan where a blob has none."""
    count = len(numbers)
    glcm = _properties(numbers[:, :GLCM_SIZE].reshape(count, len(NAMES), len(COUNTED), len(SUMS)))
    counts = numbers[:, GLCM_SIZE:].reshape(count, len(NAMES), LBP_BINS)
    shares = counts / (counts.sum(2, keepdims=True) + 1e-7)
    stats = np.stack([shares.std(2), shares.mean(2), shares.var(2)], axis=2)
    return {n: part.reshape(count, math.prod(part.shape[1:])) for n, part in (("glcm", glcm), ("lbp", shares), ("lbp_stats", stats))}


def _finish(batches):
    for frame in batches:
        for first in range(0, len(frame), FINISHED):
            part = frame.iloc[first:first + FINISHED]
            found = _measured(np.stack(part["numbers"].to_numpy()))
            yield pd.DataFrame({"image_id": part["image_id"].to_numpy(), "blob_id": part["blob_id"].to_numpy(), **{n: list(rows) for n, rows in found.items()}})


def texture_numbers(pixels: DataFrame, tile: int = tiles.TILE) -> tuple[DataFrame, DataFrame]:
    """(per blob: glcm, lbp and lbp_stats as arrays over bands; per blob, cell and direction: gradient strength).

    pixels: image_id (no nulls), blob_id, x, y, r, g, b, any_green, peaks, x0 and y0 (corner of the blob's box), split
    (whether the blob reaches into several tiles of this size), and the bands that are known already.
    """
    known = [n for n in NAMES if n in pixels.columns]
    bands = {n: c.cast("double") for n, c in band_columns(F.col("r"), F.col("g"), F.col("b"), F.col("any_green")).items() if n not in known}
    schema = ("image_id string, blob_id long, split boolean, numbers array<double>, glcm array<double>, lbp array<double>, lbp_stats array<double>, "
              "slots array<long>, codes array<long>, counts array<long>, row array<long>, col array<long>, bin array<long>, strength array<double>")
    values = ["blob_id", "r", "g", "b", "any_green", "peaks", "x0", "y0", "split", *known]
    parts = cut_lineage(tiles.map_tiles(pixels, ["image_id"], values, REACH, _work, schema, tile, bands, STACK_CELLS))
    keys = ["image_id", "blob_id"]
    pieces = parts.filter("split")
    # Squares of counts do not add up over tiles: they come from the added counts.
    added = pieces.select(*keys, F.posexplode("numbers").alias("pos", "v")).filter(~((F.col("pos") < GLCM_SIZE) & (F.col("pos") % len(SUMS) == len(SUMS) - 1)))
    pairs = pieces.select(*keys, F.explode(F.arrays_zip("slots", "codes", "counts")).alias("e")).groupBy(*keys, "e.slots", "e.codes").agg(F.sum("e.counts").alias("n"))
    squares = pairs.select(*keys, (F.col("slots") * len(SUMS) + len(SUMS) - 1).cast("int").alias("pos"), (F.col("n") * F.col("n")).cast("double").alias("v"))
    sums = added.unionByName(squares).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    filled = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    whole = filled.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(GLCM_SIZE + LBP_SIZE - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("numbers"))
    late = whole.mapInPandas(_finish, "image_id string, blob_id long, glcm array<double>, lbp array<double>, lbp_stats array<double>")
    done = parts.filter("not split").select(*keys, "glcm", "lbp", "lbp_stats").unionByName(late)
    done = done.withColumn("glcm", F.transform("glcm", lambda v: F.when(~F.isnan(v), v)))  # a blob without two neighbours has none
    cells = parts.select(*keys, F.explode(F.arrays_zip("row", "col", "bin", "strength")).alias("e")).groupBy(
        *keys, F.col("e.row").cast("int").alias("row"), F.col("e.col").cast("int").alias("col"), F.col("e.bin").cast("int").alias("bin")).agg((F.sum("e.strength") / (CELL * CELL)).alias("strength"))
    return done, cells


def texture_columns() -> list[Column]:
    """The factors of the catalogue from the arrays of :func:`texture_numbers`."""
    out = []
    for k, name in enumerate(NAMES):
        out += [F.element_at("glcm", k * len(texture.PROPERTIES) + i + 1).alias(f"{name}_{p}_avg") for i, p in enumerate(texture.PROPERTIES)]
        out.append(F.slice("lbp", k * LBP_BINS + 1, LBP_BINS).alias(f"{name}_lbp"))
        out += [F.element_at("lbp_stats", k * 3 + i + 1).alias(f"{name}_lbp_{s}") for i, s in enumerate(("stddev", "mean", "variance"))]
    return out
