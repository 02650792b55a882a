"""The factor flow on tiles against the operators for one band at a time."""

import random

import pytest
from pyspark.sql import functions as F

from leafspark.functions import color
from leafspark.functions.catalog_of_factors import scalar_columns, vector_columns
from leafspark.operators import contours, images, shape, texture
from leafspark.plans import flow

KEYS = ["image_id", "blob_id"]


@pytest.fixture(scope="module")
def photo(spark):
    """Three pictures: smooth blobs on soil, one of 70 x 45 pixels, one without any green over blue, one without an id."""
    rng = random.Random(3)
    rows = []
    for image, w, h in ((1, 70, 45), (2, 24, 20), (None, 18, 18)):
        for x in range(w):
            for y in range(h):
                leaf = (x - w // 3) ** 2 + 2 * (y - h // 2) ** 2 < (h // 2) ** 2 or (x > 3 * w // 4 and 2 < y < h // 2)
                r, g, b = (40 + rng.randrange(9), 120 + (x * y) % 37, 30 + rng.randrange(60)) if leaf else (120 + rng.randrange(20), 90 + rng.randrange(5), 100 + rng.randrange(9))
                rows.append((image, x, y, r, g, 255 if image == 2 else b))
    return spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int").cache()


@pytest.fixture(scope="module")
def wanted(photo):
    """{(image, blob): factors} by the operators that know one band."""
    mask = flow.vegetation_mask(photo)
    blobs = contours.find_blobs(mask, 6).cache()
    from leafspark.operators.grouped import join_keys
    inside = join_keys(blobs, images.hsi(photo), ["image_id", "x", "y"]).withColumn("image_id", F.coalesce("image_id", F.lit(-1))).cache()
    out = {}

    def note(df, **names):
        for r in df.collect():
            out.setdefault((r["image_id"], r["blob_id"]), {}).update({new: r[old] for new, old in names.items()})
    bands = color.all_bands(F.col("r"), F.col("g"), F.col("b")) | {n: F.col(n) for n in ("hsi_hue", "hsi_saturation", "hsi_intensity")}
    for name in ("greyscale", "yiq_q", "hsi_hue", "hsi_intensity", "hsv_hue", "green", "ycbcr_cb", "cie_a"):
        level = texture.band_levels(inside, bands[name], KEYS)
        whole = texture.to_levels(level, KEYS) if name.startswith(("yiq", "hsi")) else level
        note(texture.glcm_properties(texture.glcm(whole, KEYS), KEYS), **{f"{name}_{p}_avg": p for p in texture.PROPERTIES})
        note(texture.lbp_histogram(texture.lbp_codes(level, KEYS), KEYS), **{f"{name}_lbp": "lbp"})
    box = inside.groupBy(*KEYS).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    cells = inside.join(box, KEYS).select(*KEYS, (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "r", "g", "b")
    note(texture.hog_stats(texture.hog_descriptor(texture.hog_cells(cells, KEYS), KEYS), KEYS), hog_stddev="hog_stddev", hog_mean="hog_mean", hog_variance="hog_variance")
    traced = contours.contours(inside)
    note(shape.hull_factors(traced), roundness="roundness", solidity="solidity", convexity="convexity")
    note(shape.radial(traced), radial_var="radial_var")
    note(shape.blob_geometry(inside, KEYS), area="area", x="x", y="y", w="w", h="h", size_ratio="size_ratio")
    return out


@pytest.mark.parametrize("tile", [64, 16])
def test_flow_equals_the_operators(photo, wanted, tile):
    rows = flow.image_factors(photo, 6, agl=F.lit(2.5), tile=tile).collect()
    got = {(-1 if r["image_id"] is None else r["image_id"], r["blob_id"]): r.asDict() for r in rows}
    assert set(got) == set(wanted) and len(got) >= 4 and {k[0] for k in got} == {-1, 1, 2}
    for key, factors in wanted.items():
        for name, value in factors.items():
            assert got[key][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (key, name)
    assert set(scalar_columns()) | set(vector_columns()) <= set(rows[0].asDict())
    assert {r["agl"] for r in rows} == {2.5} and any(r["hog_mean"] is not None for r in rows)
    for image in (-1, 1, 2):
        assert sorted(r["number"] for k, r in got.items() if k[0] == image) == list(range(sum(k[0] == image for k in got)))


def test_flow_without_blobs(photo):
    assert flow.image_factors(photo, 10_000).count() == 0
    assert flow.image_factors(photo.limit(0)).count() == 0
