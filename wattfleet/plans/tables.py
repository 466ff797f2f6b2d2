"""Meter data derived from the test tables: what each column stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet.schema import PARAM_COLUMNS, READING_COLUMNS
from wattfleet.session import dealt, prepare, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: the user is the device, the event type its name, the value its one parameter."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("Device_ID"),
        F.col("event_type").alias("Meter_Name"),
        F.col("ts").alias("Time"),
        F.col("value").alias("Watts_Total"),
        F.col("event_id").alias("seq"),
    )


def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text, some with a bad time, some with sentinel cells."""
    r = readings(spark, sf_dir)
    plain = F.col("seq").cast("string")

    def cell(missing: bool = False) -> Column:
        value = (
            F.when(F.col("Meter_Name") == "error", "-1").when(F.col("Meter_Name") == "signup", "0")
        )
        if missing:
            value = value.when(F.col("Meter_Name") == "view", "NA")
        return value.otherwise(plain)

    return r.select(
        F.col("Device_ID").cast("string").alias("Device_ID"),
        "Meter_Name",
        F.when(F.col("seq") % 50 == 0, "garbage")
        .otherwise(F.date_format("Time", "yyyy-MM-dd HH:mm:ss")).alias("Time"),
        F.lit("LG6400").alias("Model"),
        cell().alias("Watts_Total"),
        cell(missing=True).alias("PF_Ave"),
        cell().alias("Frequency"),
        F.when(F.col("Meter_Name") == "error", "-1").when(F.col("Meter_Name") == "signup", "0")
        .otherwise(F.format_string("%02d:%02d:%02d", F.floor(F.col("seq") / 60), F.col("seq") % 60, F.lit(7)))
        .alias("On_Hours"),
        "seq",
    )


def wide_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text readings with all parameters; each parameter repeats the first one, shifted by its place."""
    text = text_readings(spark, sf_dir)
    number = F.col("Watts_Total").try_cast("bigint")
    plain = (F.col("Meter_Name") == "error") | (F.col("Meter_Name") == "signup")
    shifted = {
        c: F.when(plain, F.col("Watts_Total")).otherwise((number + i).cast("string"))
        for i, c in enumerate(PARAM_COLUMNS) if c not in text.columns
    }
    return text.withColumns(shifted).select(*READING_COLUMNS)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status samples: up unless the event is an error."""
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", (F.col("event_type") != "error").alias("up")
    )


def words(df: DataFrame) -> DataFrame:
    """Two register words per line item, in a range that keeps the exponent normal."""
    return df.withColumns(
        {"lo": (F.col("l_partkey") * 31) % 65536, "hi": 16256 + F.col("l_suppkey") % 1000}
    )


# Meter models in turn, the last one unknown.
MODEL_CYCLE = ["LG6400", "EN8400", "EN8100", "EN8410", "LG+5220", "LG+5310", "ELR300", "other"]


def register_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of 248 words per line item, rising by one from a start that differs by part and supplier."""
    line = table(spark, sf_dir, "lineitem")
    start = (16256 + (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 700).cast("int")
    models = F.array(*[F.lit(m) for m in MODEL_CYCLE])
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.get(models, (F.col("l_partkey") % 8).cast("int")).alias("model"),
        F.sequence(start, start + 247).alias("words"),
    )


ATTEMPT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# (block, attempt, seed): the seed turns the keys into a status.
ATTEMPTS = [(1, 1, 0), (1, 2, 5), (2, 1, 11), (2, 2, 17), (3, 1, 23), (3, 2, 31)]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read attempts per line item; a second one follows only an error, block 2 only odd lines."""
    states = F.array(F.lit("ok"), F.lit("error"), F.lit("exception"))

    def state(seed: int) -> Column:
        mixed = F.floor((F.col("l_partkey") + F.col("l_suppkey") * 3 + F.col("l_orderkey") * 7) / (seed + 1)) + seed
        return F.get(states, (mixed % 3).cast("int"))

    seeds = {(b, a): seed for b, a, seed in ATTEMPTS}
    tries = []
    for (b, a), seed in seeds.items():
        made = F.lit(True)
        if a == 2:
            made = made & (state(seeds[b, 1]) == "error")
        if b == 2:
            made = made & (F.col("l_linenumber") % 2 == 1)
        tries.append(F.when(made, F.struct(
            F.lit(b).alias("block"), F.lit(a).alias("attempt"), state(seed).alias("status"),
            F.when(state(seed) == "ok", F.array((F.col("l_partkey") % 65536).cast("int"), F.lit(10 * b + a)))
            .alias("words"),
        )))
    line = table(spark, sf_dir, "lineitem").select(*ATTEMPT_KEYS, F.explode(F.array_compact(F.array(*tries))).alias("t"))
    return line.select(*ATTEMPT_KEYS, "t.*")


def registry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small registry file per customer, in one of four shapes, with comments and alias keys."""
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    first = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(
            F.lit('{"name":"'), name, F.lit('","address":'), key, F.lit(',"model":"LG6400","location":"'), segment, F.lit('"}')))
        .when(F.col("c_custkey") % 4 == 1, F.concat(
            F.lit('{"meter_name":"'), name, F.lit('","meter_address":"'), key, F.lit('","type":"X","site":"'), segment, F.lit('"}')))
        .when(F.col("c_custkey") % 4 == 2, F.concat(
            F.lit('{"name":"","device_name":"'), name, F.lit('","device_id":'), key, F.lit(',"model":"","plant":"P // '), segment, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"name":"'), name, F.lit('","address":null,"meter_address":'), key, F.lit(',"serial":"x"}')))
    )
    items = F.concat(F.lit('[ "stray", '), first, F.lit(', /* none */ {}, {"address":"x1"}, "{x", "{}", {"address": 7.0}, {"address": "7.0"}, {"meter_address": -7.9}, '
              '{"device_id": true}, {"address": 1e300}, [{}] ] // end'))
    text = (
        F.when(F.col("c_custkey") % 3 == 0, items)
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"devices": "[{}]", "meters": '), items, F.lit("\n}")))
        .otherwise(F.concat(F.lit('{"items": '), items, F.lit("\n}")))
    )
    text = F.when(F.col("c_custkey") % 10 == 9, F.lit('{"other": [1]}')).otherwise(text)
    return c.select("c_custkey", text.alias("text"))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current and previous manifest from orders; the previous one misses some files and differs in others."""
    current = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
        F.floor("o_totalprice").cast("bigint").alias("size"),
    )
    path = F.col("path")
    previous = current.where(path % 3 != 0).select(
        "path",
        (F.col("mtime") - F.when(path % 7 == 0, 60).otherwise(0) + F.when(path % 11 == 0, 60).otherwise(0)).alias("mtime"),
        (F.col("size") + F.when(path % 5 == 0, 1).otherwise(0)).alias("size"),
    )
    return current, previous


def supplier_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as devices, with a location text that has characters unfit for a path."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    text = F.concat("r_name", F.lit(" / "), "n_name", F.lit(" #"), F.col("n_nationkey").cast("string"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", text.alias("location"))
    return table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("address"), F.col("s_name").alias("name"), "location"
    )
