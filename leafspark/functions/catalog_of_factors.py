"""The factor catalogue, built from rules: type, subtype, name, kind and colour space of every factor."""

from __future__ import annotations

# Band names by colour space, GLCM properties, and single-valued factors.
BANDS = {"GREYSCALE": ["greyscale"], "YIQ": ["yiq_y", "yiq_i", "yiq_q"],
         "HSV": ["hsv_hue", "hsv_saturation", "value"], "HSI": ["hsi_hue", "hsi_saturation", "hsi_intensity"],
         "RGB": ["blue", "green", "red"], "YCBCR": ["ycbcr_y", "ycbcr_cb", "ycbcr_cr"], "CIELAB": ["cie_l", "cie_a", "cie_b"]}
GLCM_PROPERTIES = ["homogeneity", "energy", "contrast", "dissimilarity", "ASM", "correlation"]
SHAPES = ["shape_index", "compactness", "convexity", "elongation", "eccentricity", "roundness", "solidity", "bending", "radial_var"]
COLORS = {"hue": "HSV", "saturation_mean": "HSV", "in_phase": "YIQ", "cb_mean": "YIQ"}
STATISTICS = ["stddev", "mean", "variance"]
LBP_BINS = 26


def factor_rows() -> list[tuple[str, str, str, str, str]]:
    """(type, subtype, factor, kind, space) in catalogue order."""
    rows = [("SHAPE", "NONE", name, "SCALAR", "NONE") for name in SHAPES]
    rows += [("COLOR", "NONE", name, "SCALAR", space) for name, space in COLORS.items()]
    rows.append(("POSITION", "NONE", "normalized_distance", "SCALAR", "NONE"))
    rows += [("TEXTURE", "HOG", f"hog_{stat}", "SCALAR", "GREYSCALE") for stat in STATISTICS]
    for space, bands in BANDS.items():
        if space == "RGB":
            bands = ["red", "blue", "green"]
        # Greyscale has all three statistics; in a three-band space each band has one of them. The CIELAB
        # statistics are filed under YCBCR.
        named = [(bands[0], s) for s in STATISTICS] if len(bands) == 1 else list(zip(bands, STATISTICS))
        rows += [("TEXTURE", "LBP", f"{band}_lbp_{stat}", "SCALAR", "YCBCR" if space == "CIELAB" else space) for band, stat in named]
    rows += [("TEXTURE", "GLCM", f"{band}_{prop}_avg", "SCALAR", space)
             for space, bands in BANDS.items() for band in bands for prop in GLCM_PROPERTIES]
    rows += [("TEXTURE", "LBP", f"{band}_lbp", "VECTOR", space) for space, bands in BANDS.items() for band in bands]
    return rows


def select_factors(types=(), subtypes=(), kind="SCALAR", blacklist=(), restricted=None) -> list[str]:
    """Factor names by type, subtype and kind.

    ``restricted`` is a list of (type, space): a factor passes when, for some entry, both parts match or both differ.
    """
    def passes(row):
        kind_of, sub, name, row_kind, space = row
        if (types and kind_of not in types) or (subtypes and sub not in subtypes) or row_kind != kind:
            return False
        if kind == "VECTOR":
            return True
        if name in blacklist:
            return False
        return restricted is None or any((kind_of == t) == (space == s) for t, s in restricted)
    return [row[2] for row in factor_rows() if passes(row)]


def scalar_columns() -> list[str]:
    return select_factors() + ["name", "number", "type", "agl"]


def vector_columns() -> list[str]:
    return select_factors(kind="VECTOR") + ["name", "number", "type", "agl"]
