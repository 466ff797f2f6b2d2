"""Latest row per key, last rows overall, and union of sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_device(df: DataFrame, keys: list[str], ts: str = "Time", seq: str = "seq") -> DataFrame:
    """Latest row per key by ``(ts, seq)``; rows without a time count as oldest.

    The rank filter is applied per input partition before the shuffle, so at most
    one row per key and task is moved.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), F.col(seq).desc())
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def display_key(df: DataFrame) -> Column:
    """The column that tells devices apart in a table of readings, by its name whatever the case.

    ``Device_ID``; without it ``Meter_Name`` or ``Device_Name``, the later column of the
    two; without any of them all rows are of one device, ``Unknown``.
    """
    plain = {c: c.strip().lower() for c in df.columns}
    for wanted in (("device_id",), ("meter_name", "device_name")):
        named = [c for c, name in plain.items() if name in wanted]
        if named:
            return F.col(f"`{named[-1]}`")
    return F.lit("Unknown")


def latest_for_display(df: DataFrame, ts: str = "Time", seq: str = "seq") -> DataFrame:
    """Latest row of each device by `display_key`, in the column ``device``; rows without a key are one device."""
    return latest_per_device(df.withColumn("device", display_key(df).cast("string")), ["device"], ts, seq)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key as an aggregate; also valid on a stream."""
    values = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def latest_source(df: DataFrame, keys: list[str] | None = None, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Newest file by modification time, of all or per key; the larger path wins a tie."""
    newest = F.max(F.struct(F.col(mtime), F.col(path))).alias("_newest")
    return df.groupBy(*(keys or [])).agg(newest).select(
        *(keys or []), F.col(f"_newest.{path}").alias(path), F.col(f"_newest.{mtime}").alias(mtime)
    ).where(F.col(path).isNotNull())


def tail_n(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """Last ``n`` rows, in original order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def union_sites(frames: list[DataFrame]) -> DataFrame:
    """Per-site sets as one; a column that a site lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
