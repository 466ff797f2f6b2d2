"""Streams of readings: ingest, latest table, messages, per-batch callback, retention."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from wattfleet.operators.latest import latest_by
from wattfleet.operators.quality import drop_malformed, to_silver
from wattfleet.schema import CORRUPT
from wattfleet.session import folder_names, remove_folder
from wattfleet.sources.readings import read_readings

DEFAULT_INTERVAL = "5 seconds"
PRUNE_EVERY = dt.timedelta(hours=1)


def with_trigger(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    """A fixed rate, or with ``None`` all that is available and then stop."""
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def ingest_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Silver readings from a folder into which readings files are dropped."""
    return to_silver(drop_malformed(read_readings(spark, path, stream=True, **options)).drop(CORRUPT))


def start_ingest(
    readings: DataFrame, table: str, checkpoint: str, interval: str | None = DEFAULT_INTERVAL, path: str | None = None
) -> StreamingQuery:
    """Append a stream of readings to a catalog table partitioned by date and batch; each row counts once.

    A batch writes partitions of its own number and replaces them when it runs again after a
    failure. The table is created where it is absent, at ``path`` if given. `prune_table` may
    run on it beside the stream. Another session sees new files after ``refreshTable``.
    """
    spark = readings.sparkSession
    columns = [c for c in readings.columns if c not in ("date", "batch")]
    if not spark.catalog.tableExists(table):
        empty = readings.sparkSession.createDataFrame([], readings.select(*columns, "date").schema).withColumn("batch", F.lit(0).cast("bigint"))
        writer = empty.write.partitionBy("date", "batch").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(table)

    def append(batch: DataFrame, batch_id: int) -> None:
        _replace_partitions(batch.select(*columns, "date", F.lit(batch_id).cast("bigint").alias("batch")), table)

    writer = readings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    return with_trigger(writer, interval).start()


def latest_stream(readings: DataFrame, keys: list[str], ts: str = "Time", seq: str = "seq") -> DataFrame:
    """Latest row per key of a stream; the state holds one row per key."""
    return latest_by(readings, keys, [ts, seq])


def start_latest(
    latest: DataFrame, path: str, checkpoint: str, keys: list[str], interval: str | None = DEFAULT_INTERVAL, buckets: int = 64,
    versions: int = 100,
) -> StreamingQuery:
    """Keep a table of the latest rows: each batch merges its changed keys into the buckets that hold them.

    A batch writes the buckets it touches below its own number, then publishes a list of
    which batch holds each bucket. Readers take the newest list; files are never changed,
    and go when none of the last ``versions`` lists names them.
    """

    def bucket_of(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        published = _published(spark, path)
        if batch_id in published:
            return
        changed = bucket_of(batch).persist()
        try:
            touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
            holders = _holders(spark, path, published[-1]) if published else {}
            rows, old = changed, [b for b in touched if b in holders]
            if old:
                same = F.struct(*keys)  # nulls inside a struct compare as equal
                before = _bucket_rows(spark, path, {b: holders[b] for b in old}, changed.schema)
                new_keys = changed.select(same.alias("_same"))
                rows = before.withColumn("_same", same).join(new_keys, "_same", "left_anti").drop("_same").unionByName(changed)
            if touched:
                rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
            holders |= dict.fromkeys(touched, batch_id)
            listed = spark.createDataFrame(sorted(holders.items()), "bucket int, batch long").coalesce(1)
            listed.write.mode("overwrite").parquet(f"{path}/lists/{batch_id}")
        finally:
            changed.unpersist()
        _forget(spark, path, [*published, batch_id], versions)

    writer = latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
    return with_trigger(writer, interval).start()


def _published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose list is complete, in order."""
    names = sorted(int(n) for n in folder_names(spark, f"{path}/lists") if n.isdigit())
    # Only the newest can be under way.
    return names if not names or "_SUCCESS" in folder_names(spark, f"{path}/lists/{names[-1]}") else names[:-1]


def _holders(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    return {r.bucket: r.batch for r in spark.read.schema("bucket int, batch long").parquet(f"{path}/lists/{batch_id}").collect()}


def _bucket_rows(spark: SparkSession, path: str, holders: dict[int, int], schema) -> DataFrame:
    files = [f"{path}/batch={batch}/bucket={bucket}" for bucket, batch in sorted(holders.items())]
    plain = T.StructType([f for f in schema if f.name != "bucket"])
    rows = spark.read.schema(plain).parquet(*files) if files else spark.createDataFrame([], plain)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"bucket=(\d+)", 1).cast("int") if files else F.lit(0)
    return rows.withColumn("bucket", number)


def _forget(spark: SparkSession, path: str, published: list[int], versions: int) -> None:
    """Delete lists beyond the last ``versions``, and the batches that no list names any more."""
    gone = published[:-versions]
    if not gone:
        return
    for batch_id in gone:
        remove_folder(spark, f"{path}/lists/{batch_id}")
    named = set(_holders(spark, path, published[-versions]).values())
    for name in folder_names(spark, path):
        batch = name.removeprefix("batch=")
        if name != batch and int(batch) < published[-versions] and int(batch) not in named:
            remove_folder(spark, f"{path}/{name}")


def read_latest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The newest version of a latest table with these columns. The rows are those of the call, whatever is written later."""
    published = _published(spark, path)
    holders = _holders(spark, path, published[-1]) if published else {}
    plain = spark.createDataFrame([], schema).schema
    return _bucket_rows(spark, path, holders, plain).drop("bucket")


class PublishedCounter(StreamingQueryListener):
    """Counts messages by batch, from the metric that `counted` attaches to a stream.

    A batch that runs again after a failure counts once. Add it with ``spark.streams.addListener``.
    """

    def __init__(self, name: str = "published") -> None:
        self.name, self.batches, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and event.progress.numInputRows:
            self.batches[event.progress.batchId] = seen["messages"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    @property
    def total(self) -> int:
        return sum(self.batches.values())


def counted(messages: DataFrame, name: str = "published") -> DataFrame:
    """A stream of messages with a counter for `PublishedCounter`."""
    return messages.observe(name, F.count(F.lit(1)).alias("messages"))


def publish_stream(
    messages: DataFrame, checkpoint: str, fmt: str = "kafka", interval: str | None = DEFAULT_INTERVAL, **options: str
) -> StreamingQuery:
    """Send messages to a sink, at least once: a Kafka topic, or files of one message per line."""
    if fmt != "kafka":
        messages = messages.select("value")
    writer = messages.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
    return with_trigger(writer, interval).start()


def on_batch(
    readings: DataFrame, fn: Callable[[int, DataFrame], None], checkpoint: str, interval: str | None = DEFAULT_INTERVAL
) -> StreamingQuery:
    """Call ``fn(cycle, rows)`` for every batch; cycles count from 1."""
    writer = readings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: fn(batch_id + 1, batch)
    )
    return with_trigger(writer, interval).start()


def prune_due(last: dt.datetime | None, now: dt.datetime) -> bool:
    """Whether the last pruning is at least an hour ago."""
    return last is None or now - last >= PRUNE_EVERY


def _replace_partitions(rows: DataFrame, table: str) -> None:
    """Replace the partitions that ``rows`` belong to; they may be read from the same table."""
    spark, setting = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")  # new files are staged and replace the old ones at commit
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, before)


def prune_table(spark: SparkSession, table: str, as_of: dt.datetime, days: int = 7, date: str = "date") -> None:
    """Enforce the retention on a catalog table partitioned by date, such as that of `start_ingest`.

    Old partitions are dropped and only those of the boundary day are rewritten; rows
    without a time stay. Run it hourly beside the ingest, which only adds partitions.
    """
    cutoff = as_of - dt.timedelta(days=days)
    edge = cutoff.date()
    old, boundary = [], {}
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():  # a short name for each day and batch
        spec = dict(part.split("=", 1) for part in row[0].split("/"))
        if spec[date][:4].isdigit():
            day = dt.date.fromisoformat(spec.pop(date))
            if day < edge:
                old.append((row[0], day, spec))
            elif day == edge and cutoff.time() != dt.time():
                boundary[tuple(spec.items())] = (row[0], day, spec)
    if boundary:
        columns, others = spark.table(table).columns, list(next(iter(boundary.values()))[2])
        fresh = F.col("Time").isNull() | (F.col("Time") >= F.lit(cutoff).cast("timestamp_ntz"))
        kept = spark.table(table).where((F.col(date) == F.lit(edge)) & fresh)
        if others:
            staying = {tuple(zip(others, map(str, r))) for r in kept.select(*others).distinct().collect()}
        else:
            staying = set() if kept.isEmpty() else {()}
        if staying:
            _replace_partitions(kept.select(*columns), table)
        old += [part for key, part in boundary.items() if key not in staying]
    location = next((r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r.col_name == "Location"), None)
    for name, day, spec in old:
        values = ", ".join([f"{date} = DATE'{day}'", *[f"{k} = {v}" for k, v in spec.items()]])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({values})")
        remove_folder(spark, f"{location}/{name}")  # a table at a path of its own keeps the files of dropped partitions
