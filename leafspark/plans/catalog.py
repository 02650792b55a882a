"""All registered queries."""

from leafspark.plans import catalog_blobs, catalog_contours, catalog_files, catalog_images, catalog_learning, catalog_pixels, catalog_records, catalog_streams, catalog_tables  # noqa: F401
from leafspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
