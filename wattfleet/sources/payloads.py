"""Readings as JSON messages, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wattfleet.functions.payloads import payload_json
from wattfleet.functions.scalars import seconds_to_hms
from wattfleet.schema import PARAM_COLUMNS, PARAMETERS, PAYLOAD_SCHEMA, clean_name


def build_payload(
    df: DataFrame,
    pi_name: Column,
    pi_ip: Column,
    params: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Messages as a ``value`` column, ready for a topic; works on streams too.

    On-hours typed as seconds go out as HH:MM:SS.
    """
    if dict(df.dtypes).get("On_Hours") == "bigint":
        df = df.withColumn("On_Hours", seconds_to_hms("On_Hours"))
    params = params or ["Time", *[c for c in PARAM_COLUMNS if c in df.columns]]
    optional = {k: F.col(c) if c in df.columns else None
                for k, c in (("device_id", "Device_ID"), ("model", "Model"), ("location", "location"))}
    message = payload_json(params, F.col("Meter_Name"), pi_name, pi_ip, **optional)
    return df.select(*(keep or []), message.alias("value"))


def parse_payloads(df: DataFrame, value: str = "value") -> DataFrame:
    """Text readings from messages, in the layout of the files plus ``location, pi_name, pi_ip``.

    A message that is not an object gives a row of nulls. Works on streams too.
    """
    text = F.col(value).cast("string")
    others = [c for c in df.columns if c != value]
    rows = df.select(*others, text.alias("_text"), F.from_json(text, PAYLOAD_SCHEMA).alias("_m"))
    field = lambda name: F.col("_m").getField(name)
    return rows.select(
        *others,
        field("device_id").alias("Device_ID"),
        field("meter_name").alias("Meter_Name"),
        F.coalesce(field("Time"), F.get_json_object("_text", "$.time")).alias("Time"),
        field("model").alias("Model"),
        *[field(p).alias(clean_name(p)) for p in PARAMETERS[1:]],
        *[field(c).alias(c) for c in ("location", "pi_name", "pi_ip")],
    )


def read_payloads(spark: SparkSession, path: str, stream: bool = True, **options: str) -> DataFrame:
    """Messages stored one per line, as a stream or at rest, parsed to text readings."""
    reader = spark.readStream if stream else spark.read
    return parse_payloads(reader.options(**options).text(path))


def payload_stream(df: DataFrame, pi_name: Column, pi_ip: Column, params: list[str] | None = None) -> DataFrame:
    """Keyed messages of a stream of readings, in the shape a Kafka sink expects."""
    return build_payload(
        df.withColumn("key", F.col("Device_ID").cast("string")), pi_name, pi_ip, params, keep=["key"]
    )


def published_count(df: DataFrame, name: str = "published") -> tuple[DataFrame, Observation]:
    """The frame with a counter attached; ``observation.get['messages']`` holds it after the write."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("messages")), observation
