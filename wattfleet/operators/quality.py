"""Retention, malformed rows, sentinel values, clock skew, typing of text readings."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.functions.scalars import hms_to_seconds, micros, parse_reading_time, to_integer, to_number
from wattfleet.schema import CORRUPT, PARAM_COLUMNS, SILVER_SCHEMA

COMM_FAILURE = "comm_failure"
NO_RESPONSE = "no_response"
UNSUPPORTED = "unsupported"
OK = "ok"


def _as_column(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, DataFrame):  # one row, one column: evaluated as a scalar subquery
        return value.scalar()
    return F.lit(value).cast("timestamp_ntz")


def retain(
    df: DataFrame, as_of: dt.datetime | Column | DataFrame, days: int = 7, ts: str = "Time", date: str | None = None
) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``, the boundary included; rows without a time stay.

    With the partition column ``date`` the scan skips partitions that are too old.
    """
    cutoff = _as_column(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = df.where(F.col(ts).isNull() | (F.col(ts) >= cutoff))
    if date:
        kept = kept.where(F.col(date).isNull() | (F.col(date) >= F.to_date(cutoff)))
    return kept


def drop_malformed(df: DataFrame, corrupt: str = CORRUPT) -> DataFrame:
    """Drop rows of fewer than three fields; other ragged rows stay."""
    unquoted = F.regexp_replace(F.col(corrupt), '"[^"]*+(?:""[^"]*+)*+"', "")
    fields = F.size(F.split(unquoted, ",", -1))
    return df.where(F.col(corrupt).isNull() | (fields > 2))


def _all_equal(df: DataFrame, params: list[str], value: int) -> Column:
    types = dict(df.dtypes)
    texts = [f"{value}", f"{value}.0", f"{value}.00"]
    tests = [F.col(c).isin(texts) if types[c] == "string" else F.col(c) == F.lit(value).cast(types[c]) for c in params]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def reading_quality(df: DataFrame, params: list[str] | None = None) -> Column:
    """Quality of a whole row. Single values of -1 or 0 are valid, so all must agree."""
    params = params or [c for c in PARAM_COLUMNS if c in df.columns]
    return (
        F.when(_all_equal(df, params, -1), F.lit(COMM_FAILURE))
        .when(_all_equal(df, params, 0), F.lit(NO_RESPONSE))
        .otherwise(F.lit(OK))
    )


def classify_quality(df: DataFrame, params: list[str] | None = None) -> DataFrame:
    """Add ``quality`` of the row and ``unsupported``, the number of ``NA`` cells."""
    params = params or [c for c in PARAM_COLUMNS if c in df.columns]
    texts = [c for c, t in df.dtypes if c in params and t == "string"]
    missing = sum((F.coalesce((F.col(c) == "NA").cast("int"), F.lit(0)) for c in texts), F.lit(0))
    return df.withColumns({"quality": reading_quality(df, params), "unsupported": missing})


def classify_cells(df: DataFrame, ids: list[str], params: list[str]) -> DataFrame:
    """Long form with the quality of each cell; ``value`` is null for sentinels."""
    labelled = df.withColumn("_row", reading_quality(df, params))
    cells = labelled.select(*ids, "_row", *[F.col(c).cast("string").alias(c) for c in params]).unpivot(
        [*ids, "_row"], params, "param", "text"
    )
    quality = F.when(F.col("_row") != OK, F.col("_row")).when(F.col("text") == "NA", UNSUPPORTED).otherwise(OK)
    return cells.select(
        *ids, "param", F.when(quality == OK, to_number("text")).alias("value"), quality.alias("quality")
    )


def to_silver(df: DataFrame) -> DataFrame:
    """Typed readings from text readings, with ``quality`` and ``date``.

    Sentinel rows and ``NA`` cells become null; an unparsable time becomes null and the row stays.
    """
    params = [c for c in PARAM_COLUMNS if c in df.columns]
    quality = reading_quality(df, params)

    def typed(c: str) -> Column:
        if c == "Time":
            return parse_reading_time(c)
        if c == "Device_ID":
            return to_integer(c)
        if c not in params:
            return F.col(c)
        if c == "On_Hours":
            value = hms_to_seconds(c)
        else:
            value = to_number(c)
            if SILVER_SCHEMA[c].dataType.typeName() == "long":
                value = F.floor(value)
        return F.when(F.col("_quality") == OK, value)

    silver = df.withColumn("_quality", quality)
    silver = silver.select(
        *[typed(c).alias(c) for c in df.columns if c != CORRUPT], F.col("_quality").alias("quality")
    )
    return silver.withColumn("date", F.to_date("Time")) if "Time" in silver.columns else silver


def clock_skew(df: DataFrame, device_time: str, reference_time: str, seconds: float = 2) -> DataFrame:
    """Add ``skew_seconds`` and ``skewed``: true where the clocks differ by more than ``seconds``."""
    difference = F.abs(micros(device_time) - micros(reference_time))
    return df.withColumns(
        {"skew_seconds": difference / F.lit(1e6), "skewed": difference > F.lit(round(seconds * 1_000_000))}
    )
