"""File manifests: what changed, what is new, and the manifest after a copy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MIN_AGE = 60


def changed_files(
    current: DataFrame,
    previous: DataFrame,
    mode: str = "exact",
    keys: list[str] | None = None,
    at_target: DataFrame | None = None,
) -> DataFrame:
    """Files to copy.

    ``exact``: new, or time or size differ. ``newer``: new, or modified later, or the
    size differs, or absent from ``at_target`` (the keys of files that exist there).
    """
    keys = keys or ["path"]
    before = previous.select(*keys, F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_known"))
    joined = current.join(before, keys, "left")
    size_differs = F.coalesce(F.col("size") != F.col("_size"), F.lit(True))
    if mode == "exact":
        time_differs = F.coalesce(F.col("mtime") != F.col("_mtime"), F.lit(True))
    elif mode == "newer":
        time_differs = F.coalesce(F.col("mtime") > F.col("_mtime"), F.lit(False))
    else:
        raise ValueError(f"unknown mode: {mode}")
    changed = F.col("_known").isNull() | size_differs | time_differs
    if at_target is not None:
        present = at_target.select(*keys).distinct().withColumn("_present", F.lit(True))
        joined = joined.join(present, keys, "left")
        changed = changed | F.col("_present").isNull()
    return joined.where(changed).select(*current.columns)


def insert_only(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Source rows whose key the target lacks."""
    return source.join(target, keys or ["path"], "left_anti")


def upsert_manifest(previous: DataFrame, changed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Manifest with changed entries replaced or added; entries of vanished files stay."""
    return previous.join(changed, keys or ["path"], "left_anti").unionByName(changed)


def ordered_listing(files: DataFrame) -> DataFrame:
    """Files in name order."""
    return files.orderBy("path")


def settled_only(
    files: DataFrame, as_of: dt.datetime | int | Column | DataFrame, min_age: int = DEFAULT_MIN_AGE, mtime: str = "mtime"
) -> DataFrame:
    """Files at least ``min_age`` seconds old, which are no longer being written.

    ``as_of`` is in epoch seconds, or a UTC time, or a one-row frame of epoch seconds.
    """
    if isinstance(as_of, dt.datetime):
        as_of = int(as_of.replace(tzinfo=as_of.tzinfo or dt.timezone.utc).timestamp())
    if isinstance(as_of, DataFrame):
        as_of = as_of.scalar()
    elif not isinstance(as_of, Column):
        as_of = F.lit(as_of)
    return files.where(F.col(mtime) <= as_of - max(0, int(min_age)))


def overwrite_all(df: DataFrame, path: str) -> None:
    """Replace the target without condition."""
    df.write.mode("overwrite").parquet(path)
