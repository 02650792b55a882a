"""Searches and updates over image and blob documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.sources import files


def find_images(images: DataFrame, crop: str, begin_agl: float | None = None, end_agl: float | None = None,
                begin_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Images of a crop by altitude (default 0 to 900) and date. A range needs both ends. Plain predicates, so they
    reach the file scan."""
    for low, high, name in ((begin_agl, end_agl, "altitude"), (begin_date, end_date, "date")):
        if (low is None) != (high is None):
            raise TypeError(f"both ends of the {name} range are needed")
    df = images.filter((F.col("crop") == crop) & F.col("altitude").between(0 if begin_agl is None else begin_agl, 900 if end_agl is None else end_agl))
    if begin_date is not None:
        df = df.filter(F.col("acquired").between(F.to_timestamp(F.lit(begin_date)), F.to_timestamp(F.lit(end_date))))
    return df


def find_image_by_hash(images: DataFrame, wanted) -> DataFrame:
    """The image with a hash; evaluating the result fails when there is more than one."""
    found = images.filter(F.col("hash") == wanted)
    count = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.filter(F.when(count > 1, F.raise_error(F.lit("more than one image has this hash"))).otherwise(F.lit(True)))


def duplicate_hashes(images: DataFrame) -> DataFrame:
    return images.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def find_blobs(blobs: DataFrame, **equal) -> DataFrame:
    """Blobs by id, hash, altitude, or parent and technique."""
    allowed = {"id", "hash", "altitude", "parent", "technique"}
    if set(equal) - allowed or ("parent" in equal) != ("technique" in equal):
        raise TypeError("search by id, hash, altitude, or by parent together with technique")
    df = blobs
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df


def merge_urls(updates: DataFrame, order: list[str], keys=("image_id",), key: str = "technique", value: str = "url") -> DataFrame:
    """One map per image from technique to its latest url. The latest per (image, technique) is taken first, so the
    list per image has at most one entry per technique."""
    latest = updates.groupBy(*keys, key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return latest.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("processed"))


def upsert_images(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored images with updates by image_id: entries of maps (processed, segmented and any other) are added, an update's
    entry wins over a stored one; of other columns an update's value wins if it has one. Images that are not stored yet
    are added; columns that only one side has stay. updates: at most one row an image."""
    maps = {f.name for df in (stored, updates) for f in df.schema if f.dataType.typeName() == "map"}
    both = [c for c in updates.columns if c in stored.columns and c != "image_id"]
    renamed = updates.withColumnsRenamed({c: f"_new_{c}" for c in both} | {"image_id": "_new_id"})
    joined = stored.join(renamed, F.col("image_id").eqNullSafe(F.col("_new_id")), "full")

    def merged(name):
        old, new = F.col(name), F.col(f"_new_{name}")
        if name not in maps:
            return F.coalesce(new, old)
        none = F.create_map().cast(stored.schema[name].dataType)
        old, new = F.coalesce(old, none), F.coalesce(new, none)
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return joined.select(F.coalesce("image_id", "_new_id").alias("image_id"), *[merged(c).alias(c) if c in both else F.col(c) for c in stored.columns if c != "image_id"],
                         *[F.col(c) for c in updates.columns if c not in stored.columns])


def upsert_stored(path: str, updates: DataFrame) -> int:
    """Upsert into the versioned table under path; the number of the new version."""
    spark = updates.sparkSession
    return files.write_version(upsert_images(files.read_version(spark, path), updates) if files.versions(spark, path) else updates, path)


def training_set(images: DataFrame, blobs: DataFrame, factors: list[str]) -> DataFrame:
    """Factor rows of the blobs of the found images; blobs: parent, blob, type, factors map."""
    j = images.select(F.col("image_id").alias("parent"), F.col("name").alias("_image")).join(blobs, "parent")
    return j.select(F.concat_ws("-", "_image", F.concat(F.lit("blob"), F.col("blob").cast("string"))).alias("name"),
                    *[F.col("factors")[f].alias(f) for f in factors], "type")


def apply_review(predictions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reviewed classes: actual defaults to the predicted type; a correction (name, value) replaces both."""
    fixes = corrections.groupBy("name").agg(F.max("value").alias("_fix"))
    df = predictions.join(fixes, "name", "left")
    return df.withColumns({"actual": F.coalesce("_fix", "type"), "type": F.coalesce("_fix", "type")}).drop("_fix")


def split_reviewed(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(crop and weed rows, discarded mistakes)."""
    return reviewed.filter(F.col("actual").isin(0, 1)), reviewed.filter(F.col("actual") == 3)


def with_sibling(files: DataFrame, extension: str, required: str, keep: bool = False) -> DataFrame:
    """Files of one extension that have (or, with ``keep``, do not have) a sibling with the other extension."""
    stem = F.upper(F.regexp_replace(F.col("file"), r"\.[^.]*$", ""))
    kind = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    named = files.withColumns({"_stem": stem, "_kind": kind})
    siblings = named.filter(F.col("_kind") == required.lower()).select("_stem").distinct()
    return named.filter(F.col("_kind") == extension.lower()).join(siblings, "_stem", "left_anti" if keep else "left_semi").select(*files.columns)


def pair_masks(masks: DataFrame, references: DataFrame) -> DataFrame:
    """Masks ``stem-mask-technique.ext`` with their reference ``stem-mask.ext``."""
    m = masks.select(F.col("file").alias("mask"), F.regexp_extract("file", r"^(.*)-mask-[^.]*\.", 1).alias("stem"),
                     F.regexp_extract("file", r"-mask-([^.]*)\.", 1).alias("technique"))
    r = references.select(F.col("file").alias("reference"), F.regexp_extract("file", r"^(.*)-mask\.", 1).alias("stem"))
    return m.join(r, "stem")
