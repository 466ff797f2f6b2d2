"""Listing of readings files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_listing(spark: SparkSession, path: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """``path, mtime, size`` of matching files; the content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        "path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size")
    )


def settled_options(as_of: str) -> dict[str, str]:
    """Reader options that leave out files modified after ``as_of`` (``yyyy-MM-ddTHH:mm:ss``)."""
    return {"modifiedBefore": as_of}
