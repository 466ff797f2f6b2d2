"""Readings on disk: text files in, partitioned tables and text files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet.functions.scalars import date_key, sanitize_key
from wattfleet.operators.layout import format_readings
from wattfleet.schema import BRONZE_SCHEMA, CORRUPT

CSV_OPTIONS = {"header": "true", "columnNameOfCorruptRecord": CORRUPT, "enforceSchema": "true"}


def _with_origin(df: DataFrame) -> DataFrame:
    """Add ``file``, ``site`` (the file name without its suffix) and ``seq``.

    At rest ``seq`` follows the order of a file: the row number inside the task is below
    the length of a full file split, so the start of the split plus that number grows
    along the file. A stream does not number rows; there ``seq`` is the time of the file.
    """
    if df.isStreaming:
        seq = F.unix_micros("_metadata.file_modification_time")
    else:
        row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
        seq = F.col("_metadata.file_block_start") + row
    origin = df.select("*", F.col("_metadata.file_path").alias("file"), seq.alias("seq"))
    return origin.withColumn("site", site_of("file"))


def site_of(path: str) -> Column:
    name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_readings(spark: SparkSession, paths: str | list[str], stream: bool = False, **options: str) -> DataFrame:
    """Readings files with a header, all columns as text.

    Adds ``_corrupt`` (the raw line of a ragged row), ``file``, ``site`` and ``seq``.
    """
    reader = spark.readStream if stream else spark.read
    return _with_origin(reader.schema(BRONZE_SCHEMA).options(**CSV_OPTIONS, **options).csv(paths))


def _spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """One output file per partition value where it is small, several where it is large."""
    return df.hint("rebalance", *columns)


def write_readings(df: DataFrame, path: str, date: str = "date") -> None:
    """Append to the readings table, partitioned by date; rows without a time have a partition of their own."""
    if date not in df.columns:
        df = df.withColumn(date, F.to_date("Time"))
    _spread(df, [date]).write.mode("append").partitionBy(date).parquet(path)


def export_readings(df: DataFrame, path: str) -> None:
    """Append readings as text files with a header."""
    format_readings(df).write.mode("append").option("header", True).csv(path)


def write_readings_by(df: DataFrame, path: str, columns: list[str], fmt: str = "csv") -> None:
    """Append readings under one folder per value of the columns.

    ``location_key`` and ``date_key`` are derived from ``location`` and ``Time`` where absent. A null or
    empty value goes to the default partition.
    """
    derived = {"location_key": lambda: sanitize_key("location"), "date_key": lambda: date_key("Time")}
    for name in columns:
        if name not in df.columns:
            df = df.withColumn(name, derived[name]())
    writer = _spread(df, columns).write.mode("append").partitionBy(*columns)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
