"""Picking the newest entry or the highest version of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: name of a stored model version.
VERSION_NAME = r"^checkpoint-tf-(\d+)$"


def newest_file(listing: DataFrame, prefix: str = "", extension: str = "") -> DataFrame:
    """The matching file changed last, of equal times the smallest path: one row, or none."""
    matching = listing.filter(F.col("name").startswith(prefix) & F.col("name").endswith(extension))
    if "is_dir" in listing.columns:
        matching = matching.filter(~F.col("is_dir"))
    return matching.orderBy(F.desc("modified_at"), "path").limit(1).select("path", "modified_at")


def version_number(name: Column) -> Column:
    found = F.regexp_extract(name, VERSION_NAME, 1)
    return F.when(found != "", found.try_cast("bigint"))


def latest_version(listing: DataFrame) -> DataFrame:
    """One row ``version``: the numerically highest version among folder names."""
    folders = listing.filter(F.col("is_dir")) if "is_dir" in listing.columns else listing
    return folders.agg(F.max(version_number(F.col("name"))).alias("version"))


def require_version(listing: DataFrame) -> int:
    version = latest_version(listing).first()["version"]
    if version is None:
        raise ValueError("the listing holds no model version")
    return version
