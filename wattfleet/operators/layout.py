"""Column names and shapes of readings: wide, long, nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.functions.scalars import format_value
from wattfleet.schema import ID_COLUMNS, PARAM_COLUMNS, clean_name


def clean_columns(df: DataFrame) -> DataFrame:
    """Spaces in column names become underscores; dots and brackets go."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def reading_layout(df: DataFrame, params: list[str] | None = None) -> DataFrame:
    """Identity columns first, with the model after the time; then the parameters; then any others."""
    params = [c for c in (params or PARAM_COLUMNS) if c in df.columns]
    head = [c for c in ID_COLUMNS if c in df.columns]
    rest = [c for c in df.columns if c not in head and c not in params]
    return df.select(*head, *params, *rest)


def format_readings(df: DataFrame, params: list[str] | None = None) -> DataFrame:
    """Parameter cells as text, as they are written to files."""
    return df.withColumns({c: format_value(c) for c in (params or PARAM_COLUMNS) if c in df.columns})


def wide_to_long(df: DataFrame, ids: list[str], params: list[str]) -> DataFrame:
    """One row per reading and parameter; parameters must share one type."""
    return df.unpivot(ids, params, "param", "value")


def wide_to_struct(df: DataFrame, params: list[str] | None = None) -> DataFrame:
    """``device_id, device_name, model, readings`` with the values in reading order, time first."""
    params = params or ["Time", *PARAM_COLUMNS]
    return df.select(
        F.col("Device_ID").alias("device_id"),
        F.col("Meter_Name").alias("device_name"),
        F.col("Model").alias("model"),
        F.array(*[F.col(c).cast("string") for c in params]).alias("readings"),
    )


def drop_identity(df: DataFrame) -> DataFrame:
    """Parameters only."""
    return df.drop(*ID_COLUMNS)
