"""Predicates, masks and classification rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class and reason codes.
DESIRED, UNDESIRED, UNTREATED, IGNORED, UNKNOWN = range(5)
TYPES = ["Desired", "Undesired", "Untreated", "Ignored", "Unknown"]
REASONS = ["Unknown", "At Edge", "Size", "Logistic", "KNN", "Decision Tree", "Random Forest", "Gradient", "SVM", "LDA",
           "MLP", "EXTRA", "Too Close"]
REASON_AT_EDGE, REASON_SIZE = 1, 2
FRESH_MS = 5000


def label(code: Column, names=TYPES) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), code.cast("int") + 1)


def threshold_mask(value: Column, threshold, direction: int = 1, negate: bool = False) -> Column:
    """1 where the value lies beyond the threshold: above it for a positive direction, below it otherwise."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = value > limit if direction > 0 else value < limit
    return (~hit if negate else hit).cast("int")


def two_threshold_mask(value: Column, up, down, direction: int = 1) -> Column:
    """1 above ``up`` or below ``down``; a ``down`` of None is ignored."""
    if direction <= 0:
        return (value < up).cast("int")
    hit = value > up
    return (hit if down is None else hit | (value < down)).cast("int")


def apply_mask(mask: Column, *bands: Column) -> list[Column]:
    return [band * mask for band in bands]


def at_edge(x: Column, w: Column, width) -> Column:
    return (x == 0) | (x + w >= width)


def size_ratio_type(kind: Column, area: Column, largest: Column, edge: Column, ratio: float) -> dict[str, Column]:
    """Type and reason by size; only rows of unknown type change, an edge hit wins."""
    open_row = kind == UNKNOWN
    small = largest > area * ratio
    return {"type": F.when(open_row & ~edge & small, UNDESIRED).when(open_row & ~edge, DESIRED).otherwise(kind),
            "reason": F.when(open_row & edge, REASON_AT_EDGE).when(open_row, REASON_SIZE).otherwise(0)}


def crop_row_candidate(cy: Column, height: int, margin: int = 200) -> Column:
    middle = height // 2
    return (cy > middle - margin) & (cy < middle + margin)


def is_fresh(sent: Column, now: Column, limit_ms: int = FRESH_MS) -> Column:
    """Whether a message was sent less than five seconds before ``now``."""
    return (F.unix_micros(now) - F.unix_micros(sent)) < limit_ms * 1000


def inside_box(x: Column, y: Column, left, top, width, height) -> Column:
    return (x >= left) & (x < left + width) & (y >= top) & (y < top + height)


def value_list_mask(data: Column, mask: Column, values, fill: float = -13000) -> Column:
    return F.when(mask.isin(*values), data).otherwise(F.lit(fill))


def binarise(value: Column) -> Column:
    return F.when(value > 0, 255).otherwise(value)


def parse_name(name: Column) -> dict[str, Column]:
    return {"image": F.regexp_extract(name, r"image-(\d+)-blob", 1).cast("long"),
            "blob": F.regexp_extract(name, r"-blob-?(\d+)$", 1).cast("long")}
