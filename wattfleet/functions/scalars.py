"""Column functions on readings: formatting, decoding, parsing and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits may be grouped by single underscores; white space around a number does not count.
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^\s*[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$"
_INTEGER = rf"^\s*[+-]?{_DIGITS}\s*$"
_PLAIN_TIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_TIME = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
_HMS = r"^(\d+):([0-5]?\d):([0-5]?\d)$"

_NUMERIC_TYPES = ["double", "float", "int", "bigint", "smallint", "tinyint"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text to double; null where it is not a plain decimal number."""
    text = _col(c).cast("string")
    return F.when(text.rlike(_NUMBER), F.translate(text, "_", "").try_cast("double"))


def to_integer(c: Column | str) -> Column:
    """Text to int; null where it is not a whole number or does not fit."""
    text = _col(c).cast("string")
    return F.when(text.rlike(_INTEGER), F.trim(F.translate(text, "_", "")).try_cast("int"))


def _long_digits(size: Column) -> Column:
    """All digits of a whole double from 2**62 on, exactly.

    Such a number is a long times a power of 256. The long's digits, in groups of nine
    from the lowest, are multiplied by 256 as often as needed.
    """
    group = F.lit(1_000_000_000).cast("bigint")
    times = F.ceil((F.log2(size) - 62) / 8).cast("int")
    start = (size / F.pow(F.lit(256.0), times)).cast("bigint")
    groups = F.array(start % group, _div(start, group) % group, _div(_div(start, group), group))

    def times_256(groups: Column, _: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        done = F.aggregate(groups, first, lambda at, g: F.struct(
            _div(g * 256 + at["carry"], group).alias("carry"),
            F.concat(at["out"], F.array((g * 256 + at["carry"]) % group)).alias("out"),
        ))
        return F.concat(done["out"], F.array(done["carry"]))

    all_groups = F.aggregate(F.slice(F.sequence(F.lit(0), times), 2, times), groups, times_256)
    return F.ltrim(F.array_join(F.transform(F.reverse(all_groups), lambda g: F.lpad(g.cast("string"), 9, "0")), ""), F.lit("0"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs, computed on longs."""
    return F.call_function("div", a, b)


def _number_text(number: Column) -> Column:
    """Whole numbers without decimals, others with two, halves to even."""
    size = F.abs(number)
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.when(size < F.lit(9.2e18), number.cast("bigint").cast("string")).otherwise(F.concat(sign, _long_digits(size)))
    cents = F.rint(size * 100).cast("bigint")
    small = F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
    # A double with decimals is below 2**53, so it fits.
    large = F.bround(size, 2).try_cast("decimal(38,2)").cast("string")
    # A small negative number keeps its sign although it prints as zero.
    return F.when(number == F.rint(number), whole).otherwise(
        F.concat(sign, F.when(size < F.lit(1e12), small).otherwise(large))
    )


def format_value(c: Column | str) -> Column:
    """Cell text: whole numbers without decimals, others with two, anything else unchanged.

    Whole values of any size print all their digits.
    """
    value = _col(c)
    text = value.cast("string")
    other = F.when(text == "Infinity", F.lit("inf")).when(text == "-Infinity", F.lit("-inf"))
    # The type test is a constant; the optimizer keeps one branch only.
    number = value.try_cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    from_number = F.when(F.isnan(number), F.lit("nan")).when(infinite, other).otherwise(_number_text(number))
    # The one-element array binds the parsed number, which would be parsed at every use otherwise.
    parsed = F.get(F.transform(F.array(to_number(text)), _number_text), F.lit(0))
    from_text = F.coalesce(parsed, other, text)
    return F.when(F.typeof(value).isin(*_NUMERIC_TYPES), from_number).otherwise(from_text)


def float32_bits(lo: Column, hi: Column) -> Column:
    """The 32 bits of two words, low word first, as an int."""
    return F.shiftleft(hi.cast("int"), 16).bitwiseOR(lo.cast("int"))


def decode_bits(bits: Column) -> Column:
    """IEEE-754 single from its bits, rounded to 2 decimals.

    A zero exponent needs no case of its own: such numbers round to zero either way.
    A single times 100 is exact as a double, so rounding it to an integer decides halves
    on the exact value, to even.
    """
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit(0x7FFFFF))
    finite = F.pow(F.lit(2.0), exponent - 127) * (1 + fraction / F.lit(8388608.0))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    magnitude = F.rint(F.when(exponent == 255, special).otherwise(finite) * 100) / F.lit(100.0)
    # Subtracting from zero, and not negating, leaves no -0.0.
    return F.when(bits < 0, F.lit(0.0) - magnitude).otherwise(magnitude)


def decode_float32(lo: Column | str, hi: Column | str) -> Column:
    """IEEE-754 single from two 16-bit words, low word first, rounded to 2 decimals."""
    return decode_bits(float32_bits(_col(lo), _col(hi)))


def pack_u32(hi: Column | str, lo: Column | str) -> Column:
    """Unsigned 32-bit counter from two words, high word first."""
    return F.shiftleft(_col(hi).cast("bigint"), 16).bitwiseOR(_col(lo).cast("bigint"))


def seconds_to_hms(c: Column | str) -> Column:
    """Seconds as HH:MM:SS; hours are not wrapped at 24."""
    seconds = _col(c).cast("bigint")

    def digits(n: Column) -> Column:
        text = n.cast("string")
        return F.when(n.between(0, 9), F.concat(F.lit("0"), text)).otherwise(text)

    hours = F.floor(seconds / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.concat(digits(hours), F.lit(":"), digits(minutes), F.lit(":"), digits(F.pmod(seconds, F.lit(60))))


def hms_to_seconds(c: Column | str) -> Column:
    """HH:MM:SS to seconds; null where the text has another form."""
    text = F.trim(_col(c))
    part = lambda i: F.regexp_extract(text, _HMS, i).try_cast("bigint")
    return F.when(text.rlike(_HMS), part(1) * 3600 + part(2) * 60 + part(3))


def sanitize_key(c: Column | str) -> Column:
    """Letters, digits, hyphen and underscore only; usable in a path."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}_-]", "")


def parse_reading_time(c: Column | str) -> Column:
    """Reading time; null where the text is not a valid date and time."""
    text = _col(c)
    return F.when(text.rlike(_PLAIN_TIME), text.try_cast("timestamp_ntz")).when(
        text.rlike(_TIME), F.regexp_replace(text, r"\s+", " ").try_cast("timestamp_ntz")
    )


def date_key(c: Column | str) -> Column:
    """Start date as it appears in file names."""
    return F.date_format(_col(c), "yyyyMMdd")


def json_path(c: Column | str, path: str) -> Column:
    """Value at a dotted path as text; empty where missing, null, an object or an array."""
    text = _col(c)
    json_query = "$" + "".join(f"['{part}']" for part in path.split("."))
    value = F.get_json_object(text, json_query)
    # A string may look like an object; only then is its type looked up.
    found = F.try_variant_get(F.try_parse_json(text), json_query, "variant")
    nested = value.rlike(r"^[{\[]") & F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)")
    return F.when(value.isNull() | nested, F.lit("")).otherwise(value)


def first_filled(fields: Column | str, *names: str) -> Column:
    """First non-empty value among the named entries of a string map."""
    entries = _col(fields)
    return F.coalesce(*[F.nullif(entries[n], F.lit("")) for n in names])


def micros(c: Column | str) -> Column:
    """Timestamp as microseconds since the epoch."""
    return F.unix_micros(_col(c).cast("timestamp"))
