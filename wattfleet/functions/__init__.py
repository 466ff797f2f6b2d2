from wattfleet.functions.payloads import payload_from_arrays, payload_json, zip_params
from wattfleet.functions.scalars import (
    date_key,
    decode_float32,
    first_filled,
    format_value,
    hms_to_seconds,
    json_path,
    micros,
    pack_u32,
    parse_reading_time,
    sanitize_key,
    seconds_to_hms,
    to_integer,
    to_number,
)

__all__ = [
    "date_key", "decode_float32", "first_filled", "format_value", "hms_to_seconds", "json_path", "micros",
    "pack_u32", "parse_reading_time", "payload_from_arrays", "payload_json", "sanitize_key", "seconds_to_hms",
    "to_integer", "to_number", "zip_params",
]
