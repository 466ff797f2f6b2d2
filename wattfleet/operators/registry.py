"""Device registry: alias keys, defaults, locations, joins with readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.functions.scalars import first_filled, sanitize_key, to_integer

UNKNOWN = "Unknown"
KNOWN_KEYS = ["name", "address", "model", "location"]


def _whole(entries: Column, kinds: Column | None, key: str) -> Column:
    """An entry as a whole number: numbers lose their fraction, true is one, a text must be a whole number."""
    text = entries[key]
    if kinds is None:
        return to_integer(text)
    kind = F.coalesce(kinds[key], F.lit("STRING"))
    return (
        F.when(kind == "STRING", to_integer(text))
        .when(kind == "BOOLEAN", text.try_cast("boolean").cast("int"))
        .otherwise(text.try_cast("double").try_cast("int"))
    )


def coalesce_alias(fields: Column | str, kinds: Column | str | None = None) -> dict[str, Column]:
    """Normalised device fields from a map of registry entries, and a map of the types of their values.

    An empty name gives way to its aliases. The address follows key presence: a null
    under ``address`` hides ``meter_address``; without ``kinds`` all values count as text.
    A ``model`` or ``location`` key that is present stays as it is, even if empty.
    """
    entries = F.col(fields) if isinstance(fields, str) else fields
    types = F.col(kinds) if isinstance(kinds, str) else kinds
    has = lambda key: F.map_contains_key(entries, key)
    address = (
        F.when(has("address"), _whole(entries, types, "address"))
        .when(has("meter_address"), _whole(entries, types, "meter_address"))
        .otherwise(_whole(entries, types, "device_id"))
    )
    model = F.coalesce(first_filled(entries, "meter_model", "type"), F.lit(""))
    location = F.coalesce(first_filled(entries, "site", "plant"), F.lit(UNKNOWN))
    return {
        "name": F.coalesce(first_filled(entries, "name", "meter_name", "device_name"), F.lit("")),
        "address": address,
        "model": F.when(has("model"), entries["model"]).otherwise(model),
        "location": F.when(has("location"), entries["location"]).otherwise(location),
        "extra": F.map_filter(entries, lambda k, v: ~k.isin(*KNOWN_KEYS) | ((k == "address") & _whole(entries, types, "address").isNull())),
    }


def normalize_registry(df: DataFrame, fields: str = "fields", kinds: str = "kinds") -> DataFrame:
    """Add ``name, address, model, location`` and ``extra``, the entries kept as they are."""
    return df.withColumns(coalesce_alias(fields, kinds if kinds in df.columns else None))


def registry_defaults(df: DataFrame, pos: str = "pos", fields: str = "fields") -> DataFrame:
    """Fill missing names and addresses from the 0-based position of the device in its list.

    Only absent keys are filled: an empty name or a null address that is written out stays.
    """
    number = F.col(pos) + 1
    return df.withColumns(
        {
            "name": F.when(
                (F.col("name") == "") & ~F.map_contains_key(F.col(fields), "name"),
                F.concat(F.lit("Meter_"), number.cast("string")),
            ).otherwise(F.col("name")),
            "address": F.when(
                F.col("address").isNull() & ~F.map_contains_key(F.col(fields), "address"), number.cast("int")
            ).otherwise(F.col("address")),
        }
    )


def ui_defaults(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Variant for editing: address 1 and an empty location where nothing is given."""
    entries = F.col(fields)
    known = F.coalesce(first_filled(entries, "site", "plant"), F.lit(""))
    return df.withColumns(
        {
            "address": F.when(
                F.col("address").isNull() & ~F.map_contains_key(entries, "address"), F.lit(1)
            ).otherwise(F.col("address")),
            "location": F.when(F.map_contains_key(entries, "location"), entries["location"]).otherwise(known),
        }
    )


def location_counts(registry: DataFrame) -> DataFrame:
    """Number of devices per location."""
    return registry.groupBy("location").agg(F.count(F.lit(1)).alias("devices"))


def devices_per_location(registry: DataFrame) -> DataFrame:
    """Every device with the number of devices at its location.

    The list stays one row per device: a location of any size never forms one value.
    """
    counts = location_counts(registry).withColumnRenamed("location", "_location")
    same = registry["location"].eqNullSafe(F.col("_location"))
    return registry.join(counts, same).drop("_location")


def distinct_locations(registry: DataFrame) -> DataFrame:
    """Location keys as used in paths, beside the locations that share them."""
    return registry.select(sanitize_key("location").alias("location_key"), "location").distinct()


def known_locations(readings: DataFrame, registry: DataFrame, column: str = "location_key") -> DataFrame:
    """Readings of sites that the registry names."""
    keys = registry.select(sanitize_key("location").alias(column)).distinct()
    return readings.join(keys, column, "left_semi")


def with_registry(readings: DataFrame, registry: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Attach registry columns to readings; readings of unknown devices stay, with nulls.

    The registry grows with the fleet, so no broadcast is forced: Spark broadcasts it
    below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise splits a device that
    owns too many rows in the sort-merge join (``spark.sql.adaptive.skewJoin``).
    """
    return readings.join(registry.select(*keys, *columns), keys, "left")
