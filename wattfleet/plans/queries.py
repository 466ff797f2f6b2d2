"""Registered queries: each runs one operator over the test tables, with the same result in plain SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet import functions as W
from wattfleet.operators import layout as L
from wattfleet.operators import manifest as M
from wattfleet.operators import quality as Q
from wattfleet.operators import registers as G
from wattfleet.operators import registry as R
from wattfleet.operators.cooldown import throttle
from wattfleet.operators.cycles import cycle_counts, cycle_every, number_cycles
from wattfleet.operators.latest import latest_by, latest_per_device, latest_source, tail_n, union_sites
from wattfleet.operators.latest import latest_for_display as display
from wattfleet.operators.mounts import copies_due
from wattfleet.operators.transitions import transitions
from wattfleet.plans import oracles as O
from wattfleet.plans import tables as D
from wattfleet.schema import PARAM_COLUMNS
from wattfleet.session import shared_folder, stored
from wattfleet.sources.files import file_listing
from wattfleet.sources.payloads import build_payload, parse_payloads, payload_stream, read_payloads
from wattfleet.sources.readings import export_readings, read_readings, write_readings, write_readings_by
from wattfleet.sources.registry import parse_registry, strip_comments
from wattfleet.streaming.ingest import (
    PublishedCounter, counted, latest_stream, on_batch, prune_table, publish_stream, read_latest, start_ingest, start_latest,
)
from wattfleet.streaming.stateful import stream_results, throttle_stream, transition_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Latest rows, retention, order


@query(O.LATEST.format(key="user_id"))
def latest_per_device_id(spark, sf):
    return O.reading_columns(latest_per_device(D.readings(spark, sf), ["Device_ID"]))


@query(O.LATEST.format(key="event_type"))
def latest_per_name(spark, sf):
    return O.reading_columns(latest_per_device(D.readings(spark, sf), ["Meter_Name"]))


@query(O.LATEST.format(key="user_id"))
def latest_as_aggregate(spark, sf):
    return O.reading_columns(latest_by(D.readings(spark, sf), ["Device_ID"], ["Time", "seq"]))


@query(O.LATEST_FOR_DISPLAY)
def latest_for_display(spark, sf):
    """Three sites whose headers name the device by id, by name only, and not at all."""
    df = D.readings(spark, sf)
    sites = [
        df.withColumnRenamed("Device_ID", "DEVICE_id "), df.drop("Device_ID").withColumnRenamed("Meter_Name", "device_NAME"),
        df.drop("Device_ID", "Meter_Name"),
    ]
    shown = [
        display(site).select(F.lit(i).cast("bigint").alias("site"), "device", F.col("Time").alias("time"), "seq") for i, site in enumerate(sites)
    ]
    return union_sites(shown)


@query(O.RETENTION)
def retention_7d(spark, sf):
    df = D.readings(spark, sf)
    return O.reading_columns(Q.retain(df, df.agg(F.max("Time"))))


@query(O.RETENTION_TEXT)
def retention_keeps_unparsable(spark, sf):
    df = D.text_readings(spark, sf).select("seq", F.col("Time").alias("time_text"), W.parse_reading_time("Time").alias("time"))
    return Q.retain(df, df.agg(F.max("time")), ts="time")


@query(O.LIVE_READINGS)
def live_readings(spark, sf):
    """Text readings typed, pruned to a week, and the latest row of each device."""
    silver = Q.to_silver(D.text_readings(spark, sf))
    fresh = Q.retain(silver, silver.agg(F.max("Time")))
    return latest_per_device(fresh, ["Device_ID"]).select(
        F.col("Device_ID").alias("device_id"), F.col("Meter_Name").alias("meter_name"), F.col("Time").alias("time"),
        F.col("Watts_Total").alias("watts_total"), F.col("PF_Ave").alias("pf_ave"),
        F.col("On_Hours").alias("on_hours"), "quality", "seq",
    )


@query(O.SILVER)
def silver_readings(spark, sf):
    silver = Q.to_silver(D.text_readings(spark, sf))
    return silver.select(
        "seq", F.col("Device_ID").alias("device_id"), F.col("Time").alias("time"),
        F.col("Watts_Total").alias("watts_total"), F.col("PF_Ave").alias("pf_ave"),
        F.col("On_Hours").alias("on_hours"), "quality",
    )


@query(O.TAIL)
def tail_50(spark, sf):
    return O.reading_columns(tail_n(D.readings(spark, sf), ["Time", "seq"], 50))


@query(O.UNION)
def union_of_sites(spark, sf):
    df = D.readings(spark, sf)
    sites = [
        df.where("Meter_Name = 'click'").withColumn("site", F.lit("a")),
        df.where("Meter_Name = 'error'").drop("Watts_Total").withColumn("site", F.lit("b")),
        df.where("Meter_Name IS NULL OR Meter_Name NOT IN ('click', 'error')").withColumn("site", F.lit("c")),
    ]
    return O.reading_columns(union_sites(sites), "site")


# Scalar functions


@query(O.FORMAT_VALUE)
def format_value(spark, sf):
    df = D.table(spark, sf, "events").select(
        "event_id", "value", (F.col("event_id") % 4000 / 8.0 - 100).alias("eighth"),
        F.get(
            F.array(*[F.lit(t) for t in O.CELL_TEXTS]), (F.col("event_id") % (len(O.CELL_TEXTS) + 3)).cast("int")
        ).alias("text"),
    ).withColumn("text", F.coalesce("text", F.concat(F.col("event_id").cast("string"), F.lit(".250"))))
    return df.select(
        "event_id", W.format_value("value").alias("value_text"), W.format_value("eighth").alias("eighth_text"),
        W.format_value("text").alias("cell_text"),
    )


@query(O.DECODE_FLOAT32)
def decode_float32(spark, sf):
    line = D.words(D.table(spark, sf, "lineitem"))
    return line.select("l_orderkey", "l_linenumber", "lo", "hi", W.decode_float32("lo", "hi").alias("value"))


@query(O.PACK_U32)
def pack_u32(spark, sf):
    line = D.words(D.table(spark, sf, "lineitem"))
    return line.select("l_orderkey", "l_linenumber", W.pack_u32("lo", "hi").alias("counter"))


@query(O.SECONDS_TO_HMS)
def seconds_to_hms(spark, sf):
    return D.table(spark, sf, "events").select("event_id", W.seconds_to_hms(F.col("event_id") * 37).alias("hms"))


@query(O.HMS_TO_SECONDS)
def hms_to_seconds(spark, sf):
    text = F.when(F.col("event_id") % 50 == 0, "NA").otherwise(W.seconds_to_hms(F.col("event_id") * 37))
    return D.table(spark, sf, "events").select("event_id", W.hms_to_seconds(text).alias("seconds"))


@query(O.READING_TIME)
def reading_time(spark, sf):
    df = D.text_readings(spark, sf).select("seq", W.parse_reading_time("Time").alias("time"))
    return df.select("seq", "time", W.date_key("time").alias("date_key"))


@query(O.SANITIZE_KEY)
def sanitize_key(spark, sf):
    return D.supplier_locations(spark, sf).select("address", "location", W.sanitize_key("location").alias("location_key"))


@query(O.JSON_PATH)
def json_path(spark, sf):
    nested = F.concat(F.lit('{"a": {"b": '), "props", F.lit(', "on": true, "list": [1]}}'))
    return D.table(spark, sf, "events").select(
        "event_id", W.json_path("props", "k").alias("k"), W.json_path(nested, "a.b.k").alias("deep"),
        W.json_path(nested, "a.on").alias("flag"), W.json_path(nested, "a.b").alias("object"),
        W.json_path(nested, "a.list").alias("list"), W.json_path(nested, "a.none").alias("missing"),
    )


# Register dumps


@query(O.registers())
def registers_to_params(spark, sf):
    return G.registers_to_params(D.register_dumps(spark, sf)).select("l_orderkey", "l_linenumber", "model", *PARAM_COLUMNS)


@query(O.registers_long())
def registers_to_long(spark, sf):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return G.registers_to_long(D.register_dumps(spark, sf)).groupBy("model", "param", "quality").agg(
        F.count(F.lit(1)).alias("readings"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.sum(cents).alias("cents"),
    )


@query(O.attempts())
def resolve_attempts(spark, sf):
    got = G.resolve_attempts(D.attempts(spark, sf), D.ATTEMPT_KEYS)
    return got.select(
        *D.ATTEMPT_KEYS, "outcome", F.array_join("words", ",").alias("words"), "hours_outcome",
        F.array_join("hours_words", ",").alias("hours_words"),
    )


# Quality


@query(O.QUALITY)
def classify_quality(spark, sf):
    df = Q.classify_quality(D.text_readings(spark, sf), ["Watts_Total", "PF_Ave", "Frequency"])
    return df.select("seq", "quality", "unsupported")


@query(O.CELLS)
def classify_cells(spark, sf):
    return Q.classify_cells(D.text_readings(spark, sf), ["seq"], ["Watts_Total", "PF_Ave", "Frequency"])


@query(O.MALFORMED)
def drop_malformed(spark, sf):
    line = F.get(F.array(*[F.lit(t) for t in O.RAGGED_LINES]), (F.col("event_id") % 10).cast("int"))
    return Q.drop_malformed(D.table(spark, sf, "events").select("event_id", line.alias("_corrupt"))).select("event_id")


@query(O.CLOCK_SKEW)
def clock_skew(spark, sf):
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    line = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.clock_skew(joined, "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "skew_seconds", "skewed")


# Registry


def _devices(spark, sf):
    texts = D.registry_texts(spark, sf)
    return R.normalize_registry(parse_registry(texts.withColumn("text", strip_comments(F.col("text")))))


@query(O.registry(defaults=False))
def registry_normalized(spark, sf):
    return _devices(spark, sf).select("c_custkey", "pos", "name", "address", "model", "location", F.size("extra").cast("bigint").alias("extras"))


@query(O.registry(defaults=True))
def registry_defaults(spark, sf):
    filled = R.registry_defaults(_devices(spark, sf))
    return filled.select("c_custkey", "pos", "name", "address", "model", "location", F.size("extra").cast("bigint").alias("extras"))


def _customers(spark, sf):
    return D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("address"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("location")
    )


@query(O.DEVICES_PER_LOCATION)
def devices_per_location(spark, sf):
    return R.devices_per_location(_customers(spark, sf)).select("address", "name", "location", "devices")


@query(O.LOCATION_COUNTS)
def location_counts(spark, sf):
    return R.location_counts(_customers(spark, sf))


@query(O.DISTINCT_LOCATIONS)
def distinct_locations(spark, sf):
    return R.distinct_locations(D.supplier_locations(spark, sf))


@query(O.KNOWN_LOCATIONS)
def known_locations(spark, sf):
    place = F.concat(F.lit("NATION_"), (F.col("Device_ID") % 40).cast("string"))
    registry = D.table(spark, sf, "nation").select(F.concat("n_name", F.lit(" !")).alias("location"))
    sited = D.readings(spark, sf).withColumn("location_key", place)
    return O.reading_columns(R.known_locations(sited, registry), "location_key")


@query(O.WITH_REGISTRY)
def readings_with_registry(spark, sf):
    registry = _customers(spark, sf).withColumnRenamed("address", "Device_ID")
    return O.reading_columns(R.with_registry(D.readings(spark, sf), registry, ["Device_ID"], ["name", "location"]), "name", "location")


# Manifests


@query(O.CHANGED_EXACT)
def changed_files_exact(spark, sf):
    current, previous = D.manifests(spark, sf)
    return M.changed_files(current, previous)


@query(O.CHANGED_NEWER)
def changed_files_newer(spark, sf):
    current, previous = D.manifests(spark, sf)
    return M.changed_files(current, previous, "newer", at_target=current.where(F.col("path") % 13 != 0))


@query(O.INSERT_ONLY)
def insert_only(spark, sf):
    return M.insert_only(*D.manifests(spark, sf))


@query(O.UPSERT)
def upsert_manifest(spark, sf):
    current, previous = D.manifests(spark, sf)
    seen = current.where(F.col("path") % 2 == 0)  # odd files have vanished
    return M.upsert_manifest(previous, M.changed_files(seen, previous))


@query(O.SETTLED)
def settled_only(spark, sf):
    current, _ = D.manifests(spark, sf)
    return M.settled_only(current, current.agg(F.max("mtime")), min_age=86400)


@query(O.ORDERED_LISTING)
def ordered_listing(spark, sf):
    return M.ordered_listing(D.manifests(spark, sf)[0])


@query(O.LATEST_SOURCE)
def latest_source_per_customer(spark, sf):
    files = D.table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime")
    )
    return latest_source(files, ["o_custkey"])


# Order within a device


@query(O.TRANSITIONS.format(initial="NULL"))
def transitions_baseline(spark, sf):
    return transitions(D.status(spark, sf), ["user_id"], seq="event_id").drop("up")


@query(O.TRANSITIONS.format(initial="FALSE"))
def transitions_initial_false(spark, sf):
    return transitions(D.status(spark, sf), ["user_id"], seq="event_id", initial=False).drop("up")


@query(O.THROTTLE.format(hours=12, bypass="FALSE"))
def throttle_12h(spark, sf):
    return throttle(D.status(spark, sf), ["user_id"], 12 * 3600, seq="event_id").drop("up")


@query(O.THROTTLE.format(hours=24, bypass="event_id % 20 = 0"))
def throttle_with_bypass(spark, sf):
    df = D.status(spark, sf).withColumn("forced", F.col("event_id") % 20 == 0)
    return throttle(df, ["user_id"], 24 * 3600, seq="event_id", bypass="forced").drop("up", "forced")


@query(O.CYCLES)
def numbered_cycles(spark, sf):
    return number_cycles(D.status(spark, sf), ["user_id"], "ts", "event_id").select("user_id", "event_id", "cycle")


@query(O.CYCLE_EVERY_10)
def cycle_every_10(spark, sf):
    return cycle_every(D.status(spark, sf), 10, ["user_id"], "ts", "event_id").select("user_id", "event_id", "cycle")


@query("SELECT user_id, count(*) AS cycles FROM events GROUP BY user_id")
def cycles_per_device(spark, sf):
    return cycle_counts(D.status(spark, sf), ["user_id"])


# Shapes and messages


@query(O.WIDE_TO_LONG)
def wide_to_long(spark, sf):
    params = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return L.wide_to_long(D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *params), ["l_orderkey", "l_linenumber"], params)


@query(O.WIDE_TO_STRUCT)
def wide_to_struct(spark, sf):
    df = D.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("Device_ID"), F.col("l_returnflag").alias("Meter_Name"), F.col("l_linestatus").alias("Model"),
        F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("c"),
    )
    return L.wide_to_struct(df, ["a", "b", "c"]).withColumn("readings", F.array_join("readings", ","))


@query(O.LAYOUT)
def reading_layout(spark, sf):
    df = D.text_readings(spark, sf).select("seq", "Frequency", "PF_Ave", F.col("Watts_Total").alias("Watts Total"), "Model", "Time", "Meter_Name", "Device_ID")
    return L.reading_layout(L.clean_columns(df))


@query(O.FORMATTED)
def formatted_readings(spark, sf):
    df = D.readings(spark, sf).withColumn("Frequency", F.col("seq") / 8.0)
    return L.drop_identity(L.format_readings(df))


@query(O.ZIP_PARAMS)
def zip_params(spark, sf):
    names = F.array(*[F.lit(n) for n in ("Time", "A", "B", "C")])
    values = F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    zipped = W.zip_params(names, F.slice(values, F.lit(1), F.col("l_linenumber") % 5))
    df = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", zipped.alias("m"))
    return df.select(
        "l_orderkey", "l_linenumber", F.size("m").cast("bigint").alias("n"),
        *[F.col("m")[k].alias(f"v_{k.lower()}") for k in ("Time", "A", "B", "C")],
    )


def _messages(spark, sf):
    df = D.readings(spark, sf).select(
        "Device_ID", "Meter_Name", F.date_format("Time", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.lit("LG6400").alias("Model"),
        F.col("seq").alias("No_of_interruption"),
        F.when(F.col("seq") % 5 != 0, F.col("seq") % 100).alias("Watts_Total"),
        F.when(F.col("seq") % 3 != 0, F.lit("Plant")).alias("location"), "seq",
    )
    return build_payload(
        df, F.lit("pi"), F.lit("192.0.2.1"), ["Time", "Watts_Total", "No_of_interruption"], keep=["seq"]
    )


@query(O.PAYLOAD)
def payload_text(spark, sf):
    return _messages(spark, sf)


@query(O.PAYLOAD_ROUNDTRIP)
def payload_roundtrip(spark, sf):
    return parse_payloads(_messages(spark, sf)).select(
        "seq", F.col("Device_ID").alias("device_id"), F.col("Meter_Name").alias("meter_name"),
        W.parse_reading_time("Time").alias("time"), F.col("Model").alias("model"),
        F.col("Watts_Total").cast("bigint").alias("watts_total"), F.col("PF_Ave").alias("pf_ave"), "location", "pi_name",
    )


# Files: written and read again


@query(O.EXPORTED)
def exported_readings(spark, sf):
    """Text readings through text files with a header, malformed lines dropped, all parameters typed."""
    out = shared_folder(spark, "export")
    export_readings(stored(D.wide_readings(spark, sf), "wide"), out)
    silver = Q.to_silver(Q.drop_malformed(read_readings(spark, out)))
    numbers = [F.col(c).alias(c.lower()) for c in PARAM_COLUMNS]
    return silver.select(F.col("Device_ID").alias("device_id"), F.col("Meter_Name").alias("meter_name"), F.col("Time").alias("time"), *numbers, "quality")


@query(O.STORED)
def stored_readings(spark, sf):
    """Two appends to the table partitioned by date."""
    out, df = shared_folder(spark, "stored"), D.readings(spark, sf)
    write_readings(df.where(F.col("seq") % 2 == 0), out)
    write_readings(df.where(F.col("seq") % 2 == 1), out)
    return O.reading_columns(spark.read.parquet(out), F.col("date").cast("string").alias("date"))


@query(O.BY_LOCATION)
def readings_by_location(spark, sf):
    """One folder for each location and day."""
    out = shared_folder(spark, "by-location")
    located = D.readings(spark, sf).withColumn("location", F.concat(F.lit("Site / "), (F.col("Device_ID") % 5).cast("string"), F.lit(" #")))
    write_readings_by(located, out, ["location_key", "date_key"], "parquet")
    rows = spark.read.option("basePath", out).parquet(f"{out}/location_key=Site2", f"{out}/location_key=Site4")
    return O.reading_columns(rows, "location_key", F.col("date_key").cast("string").alias("date_key"))


@query(O.LISTED)
def listed_files(spark, sf):
    """Folders of the readings files that a listing finds, with their number of files above none."""
    out = shared_folder(spark, "listing")
    write_readings_by(D.readings(spark, sf), out, ["date_key"], "csv")
    files = file_listing(spark, out)
    folder = F.regexp_extract("path", "date_key=([0-9]+)/[^/]+[.]csv$", 1)
    return files.groupBy(folder.alias("date_key")).agg((F.min("size") > 0).alias("filled"), (F.min("mtime") > 0).alias("timed"))


@query(O.OVERWRITTEN)
def overwritten(spark, sf):
    """A copy that replaces what was there."""
    out, df = shared_folder(spark, "overwrite"), D.readings(spark, sf)
    M.overwrite_all(df, out)
    M.overwrite_all(df.where(F.col("Meter_Name") == "error"), out)
    return O.reading_columns(spark.read.parquet(out))


# One device with a third of all events


def _crowded(spark, sf):
    """Status samples, a third of them of one device and a tenth of these at one time."""
    crowded = F.col("event_id") % 3 == 0
    return D.status(spark, sf).withColumns({
        "user_id": F.when(crowded, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")),
        "ts": F.when(crowded & (F.col("event_id") % 30 == 0), F.lit("2024-01-02").cast("timestamp_ntz")).otherwise(F.col("ts")),
    })


@query(O.crowded(O.TRANSITIONS.format(initial="NULL")))
def transitions_hot_device(spark, sf):
    return transitions(_crowded(spark, sf), ["user_id"], seq="event_id").drop("up")


@query(O.crowded(O.CYCLES))
def numbered_cycles_hot_device(spark, sf):
    return number_cycles(_crowded(spark, sf), ["user_id"], "ts", "event_id").select("user_id", "event_id", "cycle")


@query(O.crowded(O.CYCLE_EVERY_10))
def cycle_every_10_hot_device(spark, sf):
    return cycle_every(_crowded(spark, sf), 10, ["user_id"], "ts", "event_id").select("user_id", "event_id", "cycle")


@query(O.crowded(O.THROTTLE.format(hours=2, bypass="event_id % 200 = 0")))
def throttle_hot_device(spark, sf):
    df = _crowded(spark, sf).withColumn("forced", F.col("event_id") % 200 == 0)
    return throttle(df, ["user_id"], 2 * 3600, seq="event_id", bypass="forced").drop("up", "forced")


@query(O.THROTTLE_SUCCESS)
def throttle_failed_actions(spark, sf):
    """A failed action starts no cooldown."""
    return throttle(D.status(spark, sf), ["user_id"], 12 * 3600, seq="event_id", success="up").drop("up")


@query(O.COPIES_ALLOWED)
def copies_allowed(spark, sf):
    """Polls of mounts: a host that had none and has some copies to all at once, others wait for the cooldown."""
    samples = D.table(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("host"), F.col("user_id").alias("mount"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("poll"),
        (F.col("event_type") != "error").alias("present"),
    )
    return copies_due(samples, ["host"], "mount", 12 * 3600, "present", "poll")


# Streams: the same results as at rest


def _stream(spark, sf, name="events"):
    schema = D.table(spark, sf, name).schema
    # A pattern, because a stream takes a single file only through one.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


_SLICES = 4


def _arriving(spark, sf, order, closed=False):
    """Status samples as a stream of one file for each slice of time, in the given order, a file for a batch.

    ``closed`` ends it with a row without a key, later than all others by twice their whole span.
    """
    rows = D.status(spark, sf)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    span = max((last - first).total_seconds(), 1) if first else 1
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) / 1e6
    part = F.least(F.floor(at / (span / _SLICES)), F.lit(_SLICES - 1))
    folder = shared_folder(spark, "arriving")
    for i in order:
        # Small row groups, so that several tasks read the file of a batch; several tasks choose its rows, too.
        rows.where(part == i).repartition(1).write.mode("append").option("parquet.block.size", 1 << 23).parquet(folder)
    if closed:
        closing = rows.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(2 * span))).alias("ts"))
        nothing = {"user_id": F.lit(None).cast("bigint"), "event_id": F.lit(None).cast("bigint"), "up": F.lit(False)}
        closing.withColumns(nothing).select(*rows.columns).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream, span


def _reading_stream(spark, sf, folder, parts=_SLICES):
    """Readings as a stream of files that arrive one for a batch, dealt by number, so that times mix."""
    rows = D.readings(spark, sf).withColumn("date", F.to_date("Time"))
    for i in range(parts):
        rows.where(F.col("seq") % parts == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(O.LATEST.format(key="user_id"))
def stream_latest(spark, sf):
    out = shared_folder(spark, "latest")
    df = _reading_stream(spark, sf, f"{out}/in", 2).drop("date")
    start_latest(latest_stream(df, ["Device_ID"]), f"{out}/table", f"{out}/checkpoint", ["Device_ID"], None).awaitTermination()
    return O.reading_columns(read_latest(spark, f"{out}/table", df.schema))


@query(O.RETENTION)
def pruned_table(spark, sf):
    """A table that a stream fills and the retention prunes, in turn."""
    out, table = shared_folder(spark, "ingest"), f"readings_{os.urandom(8).hex()}"
    now = D.readings(spark, sf).agg(F.max("Time")).first()[0]
    for parts in (1, 3):
        stream = _reading_stream(spark, sf, f"{out}/in", parts) if parts == 1 else stream
        start_ingest(stream, table, f"{out}/checkpoint", None, path=f"{out}/table").awaitTermination()
        if now is not None:
            prune_table(spark, table, now)
    spark.catalog.refreshTable(table)
    return O.reading_columns(spark.table(table))


@query(O.PUBLISHED)
def published_counts(spark, sf):
    """Messages counted while they are sent, batch by batch."""
    out, counter = shared_folder(spark, "published"), PublishedCounter()
    spark.streams.addListener(counter)
    try:
        messages = payload_stream(_reading_stream(spark, sf, f"{out}/in"), F.lit("pi"), F.lit("192.0.2.1"))
        query = publish_stream(counted(messages), f"{out}/checkpoint", "text", None, path=f"{out}/topic")
        query.awaitTermination()
        counter.ended.wait(60)
    finally:
        spark.streams.removeListener(counter)
    sent = spark.read.text(f"{out}/topic").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(sorted(counter.batches.items()), "batch long, messages long").withColumn("rows_sent", sent.scalar())


@query(O.ON_BATCH)
def batch_callback(spark, sf):
    """The number of the cycle and the newest reading, told to a callback for every batch."""
    out, told = shared_folder(spark, "callback"), []

    def tell(cycle, rows):
        newest = rows.agg(F.count(F.lit(1)).alias("n"), F.max_by("seq", F.struct("Time", "seq")).alias("seq")).first()
        told.append((cycle, newest.n, newest.seq))

    on_batch(_reading_stream(spark, sf, f"{out}/in"), tell, f"{out}/checkpoint", None).awaitTermination()
    return spark.createDataFrame(told, "cycle long, readings long, newest long")


@query(O.PUBLISHED_READINGS)
def published_readings(spark, sf):
    """Readings sent as messages by a stream, read from their folder by the consumer."""
    out = shared_folder(spark, "topic")
    messages = payload_stream(_reading_stream(spark, sf, f"{out}/in", 2), F.lit("pi"), F.lit("192.0.2.1"))
    publish_stream(messages, f"{out}/checkpoint", "text", None, path=f"{out}/topic").awaitTermination()
    return read_payloads(spark, f"{out}/topic", stream=False).select(
        F.col("Device_ID").alias("device_id"), F.col("Meter_Name").alias("meter_name"), W.parse_reading_time("Time").alias("time"),
        W.to_number("Watts_Total").alias("watts_total"), "pi_name",
    )


@query(O.TRANSITIONS.format(initial="NULL"))
def stream_transitions(spark, sf):
    out = shared_folder(spark, "transitions")
    stream, _ = _arriving(spark, sf, range(_SLICES))
    transition_stream(stream, out, ["user_id"], seq="event_id", interval=None).awaitTermination()
    return stream_results(stream, out).select("user_id", "ts", "event_id")


@query(O.THROTTLE.format(hours=12, bypass="FALSE"))
def stream_throttle(spark, sf):
    """Slices of time arrive in the wrong order, within the delay."""
    out = shared_folder(spark, "throttle")
    stream, span = _arriving(spark, sf, [1, 0, 3, 2], closed=True)
    delay = f"{int(span) + 1} seconds"
    throttle_stream(stream, out, ["user_id"], 12 * 3600, seq="event_id", interval=None, delay=delay).awaitTermination()
    return stream_results(stream, out).select("user_id", "ts", "event_id")
