"""Copies to removable drives: which drives are due at a poll."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.operators.cooldown import throttle
from wattfleet.operators.transitions import transitions


def copies_due(
    samples: DataFrame, host: list[str], mount: str, cooldown_seconds: float, present: str = "present", poll: str = "ts"
) -> DataFrame:
    """Rows ``(host, mount, poll)``: drives present at a poll that may be copied to.

    A host that had no drive at its last poll and has one now frees all its drives; any
    other drive waits for the cooldown since its last copy. Several samples of a drive at a
    poll count as one, present if one of them is. Polls without a time never copy.
    """
    seen = samples.groupBy(*host, mount, poll).agg(F.coalesce(F.bool_or(present), F.lit(False)).alias("_present"))
    hosts = seen.groupBy(*host, poll).agg(F.bool_or("_present").alias("_present"))
    inserted = transitions(hosts, host, "_present", poll, poll, initial=False)
    # Nulls inside a struct compare as equal.
    at = F.struct(*host, poll)
    freed = inserted.select(at.alias("_at"), F.lit(True).alias("_freed"))
    there = seen.where("_present").withColumn("_at", at).join(freed, "_at", "left").drop("_at", "_present")
    return throttle(there, [*host, mount], cooldown_seconds, poll, poll, bypass="_freed").select(*host, mount, poll)
