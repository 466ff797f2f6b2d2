"""Pairing of names with values, and the JSON message built from a reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattfleet.functions.scalars import _col
from wattfleet.schema import PARAMETERS, clean_name


def zip_params(names: Column | str, values: Column | str) -> Column:
    """Map of names to values by position; the longer side is cut, a repeated name keeps its last value."""
    names, values = _col(names), _col(values)
    length = F.least(F.size(names), F.size(values))
    names, values = F.slice(names, F.lit(1), length), F.slice(values, F.lit(1), length)
    pairs = F.transform(names, lambda n, i: F.struct(n.alias("key"), F.get(values, i).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, length), p["key"]))
    return F.map_from_entries(last)


def payload_from_arrays(
    names: Column | str,
    values: Column | str,
    meter_name: Column,
    pi_name: Column,
    pi_ip: Column,
    device_id: Column | None = None,
    model: Column | None = None,
    location: Column | None = None,
) -> Column:
    """JSON message from parallel name and value arrays."""
    names, values = _col(names), _col(values)
    null = F.lit(None).cast("string")
    starts_with_time = (F.size(names) > 0) & (F.size(values) > 0) & (F.lower(F.get(names, F.lit(0))) == "time")
    time = F.when(starts_with_time, F.get(values, F.lit(0)))
    meta = {
        "pi_name": pi_name, "pi_ip": pi_ip, "meter_name": meter_name, "time": time,
        "device_id": device_id, "model": model, "location": location,
    }
    entries = F.array(*[
        F.struct(F.lit(k).alias("key"), (null if v is None else v.cast("string")).alias("value"))
        for k, v in meta.items()
    ])
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    zipped = F.map_filter(zip_params(names, values), lambda k, v: ~k.isin(*meta))
    return F.to_json(F.map_concat(zipped, F.map_from_entries(present)))


def payload_json(
    columns: list[str],
    meter_name: Column,
    pi_name: Column,
    pi_ip: Column,
    device_id: Column | None = None,
    model: Column | None = None,
    location: Column | None = None,
) -> Column:
    """JSON message from a wide row that has the given reading columns.

    Keys are the display names of the parameters; null fields are left out.
    """
    shown = {clean_name(p): p for p in PARAMETERS}
    fields = [F.col(c).alias(shown.get(c, c)) for c in columns]
    fields += [pi_name.alias("pi_name"), pi_ip.alias("pi_ip"), meter_name.alias("meter_name")]
    if columns and columns[0].lower() == "time":
        fields.append(F.col(columns[0]).alias("time"))
    for name, value in (("device_id", device_id), ("model", model), ("location", location)):
        if value is not None:
            fields.append(value.alias(name))
    return F.to_json(F.struct(*fields), {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})
