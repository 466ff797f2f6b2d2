"""Array expressions that several native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 512


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_totals(numbers: Column) -> Column:
    """For each element of an array of longs the sum of those before it.

    A fold that appends copies its array at every step, so it runs inside blocks and
    once over the blocks' sums: n * 512 steps at most instead of n * n.
    """
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")

    def totals(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), none.alias("list"))
        return F.aggregate(values, first, lambda at, x: F.struct(
            (at["sum"] + x).alias("sum"), F.concat(at["list"], F.array(at["sum"])).alias("list")
        ))["list"]

    def by_blocks(values: Column) -> Column:
        last = F.ceil(F.size(values) / _BLOCK).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
        return bound(blocks, lambda parts: F.flatten(F.zip_with(
            parts, totals(F.transform(parts, lambda b: F.aggregate(b, zero, lambda s, x: s + x)), zero), totals
        )))

    return bound(numbers, lambda values: F.when(F.size(values) > 0, by_blocks(values)).otherwise(none))


def matches(text: Column, pattern: Column, measure) -> Column:
    """Structs ``(start, end, value, before)`` of the matches of a pattern.

    ``measure`` gives the length of a piece of text; places are sums of it.
    ``before`` is the text since the match before.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def measured(both: Column) -> Column:
        values, gaps = both["values"], F.slice(both["pieces"], 1, F.size(both["values"]))
        sized = F.zip_with(gaps, values, lambda g, m: F.struct(
            g.alias("before"), m.alias("value"), measure(g).cast("long").alias("gap"), measure(m).cast("long").alias("length")
        ))
        return bound(sized, lambda each: F.zip_with(
            each, running_totals(F.transform(each, lambda x: x["gap"] + x["length"])),
            lambda x, total: F.struct(
                (total + x["gap"]).alias("start"), (total + x["gap"] + x["length"]).alias("end"), x["value"].alias("value"), x["before"].alias("before")
            ),
        ))

    return bound(F.struct(found.alias("values"), F.split(text, pattern, -1).alias("pieces")), measured)
