import datetime as dt
import json
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_ordered import SCHEMA, T0, brute_throttle, histories, random_events
from test_readings import HEADER, csv_line
from wattfleet.operators.cooldown import throttle
from wattfleet.operators.latest import latest_by
from wattfleet.schema import PARAM_COLUMNS
from wattfleet.sources.payloads import payload_stream, read_payloads
from wattfleet.streaming import ingest as T
from wattfleet.streaming import stateful as ST
from wattfleet.streaming.stateful import late_rows, stream_results, throttle_stream, transition_stream


def finish(query):
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive


def in_batches(spark, tmp_path, groups):
    """A stream that delivers the given groups of rows one batch after the other."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        yield stream, i


def ordered_groups(seed, n=3):
    rows = sorted(random_events(seed, n=200, with_null_times=False), key=lambda r: (r[1], r[2]))
    size = len(rows) // n + 1
    return rows, [rows[i : i + size] for i in range(0, len(rows), size)]


def results(spark, folder, read=stream_results):
    return sorted(r.seq for r in read(spark.createDataFrame([], SCHEMA), folder).collect())


def edges(rows, before_first):
    expected = []
    for history in histories(rows).values():
        before = before_first
        for row in history:
            if row[3] and not before:
                expected.append(row[2])
            before = row[3]
    return sorted(expected)


@pytest.mark.parametrize("initial", [None, False])
def test_transition_stream(spark, tmp_path, initial):
    rows, groups = ordered_groups(21, n=4)
    late = [groups[0].pop(3), groups[1].pop(7)]
    untimed = (1, None, 9999, True, False)
    groups[3].extend([*late, untimed])
    out = str(tmp_path / "out")
    for stream, _ in in_batches(spark, tmp_path, groups):
        finish(transition_stream(stream, out, ["device"], initial=initial, interval=None))
    on_time = [r for r in rows if r not in late]
    assert results(spark, out) == edges(on_time, initial is not False)
    assert results(spark, out, late_rows) == sorted([r[2] for r in late] + [9999])


def in_files(spark, folder, groups):
    """A stream over files of the given groups of rows, one file for a batch."""
    for rows in groups:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


CLOSING = [(None, T0 + dt.timedelta(days=9), None, False, False)]


def test_throttle_stream_orders_rows(spark, tmp_path):
    rows, groups = ordered_groups(22, n=5)
    shuffled = [groups[i][::-1] for i in (1, 0, 2, 4, 3)] + [CLOSING]
    out = str(tmp_path / "out")
    stream = in_files(spark, str(tmp_path / "in"), shuffled)
    finish(throttle_stream(stream, out, ["device"], 600, bypass="force", interval=None, delay="4 hours"))
    assert results(spark, out) == sorted(brute_throttle(rows, 600, True)) and results(spark, out, late_rows) == []
    assert stream_results(stream, out).columns == stream.columns


def test_throttle_stream_keeps_late_rows(spark, tmp_path):
    rows, groups = ordered_groups(26, n=4)
    late = [groups[0].pop(3), groups[0].pop(7)]
    untimed = (1, None, 9999, True, False)
    groups[3].extend([*late, untimed])
    out = str(tmp_path / "out")
    stream = in_files(spark, str(tmp_path / "in"), [*groups, CLOSING])
    finish(throttle_stream(stream, out, ["device"], 600, interval=None, delay="10 seconds"))
    on_time = [r for r in rows if r not in late]
    assert results(spark, out) == sorted(brute_throttle(on_time, 600, False))
    assert results(spark, out, late_rows) == sorted([r[2] for r in late] + [9999])
    # What came too late can be run with everything else at rest.
    everything = spark.createDataFrame(on_time, SCHEMA).unionByName(late_rows(stream, out))
    fired = throttle(everything, ["device"], 600).collect()
    assert sorted(r.seq for r in fired) == sorted(brute_throttle(rows, 600, False))


@pytest.mark.parametrize("kind", ["transitions", "cooldown"])
def test_a_repeated_batch_gives_the_same_rows(spark, tmp_path, kind):
    rows, groups = ordered_groups(23, n=4)
    out = tmp_path / "out"
    stream = in_files(spark, str(tmp_path / "in"), [*groups, CLOSING])

    def run():
        if kind == "transitions":
            finish(transition_stream(stream, str(out), ["device"], interval=None))
        else:
            finish(throttle_stream(stream, str(out), ["device"], 600, bypass="force", interval=None))

    run()
    once = results(spark, str(out))
    expected = edges(rows, True) if kind == "transitions" else sorted(brute_throttle(rows, 600, True))
    assert once == expected
    batches = max(int(f.name) for f in (out / "checkpoint" / "commits").iterdir() if f.name.isdigit())
    (out / "checkpoint" / "commits" / f"{batches}").unlink()
    (out / "checkpoint" / "commits" / f".{batches}.crc").unlink(missing_ok=True)
    run()
    assert results(spark, str(out)) == once


def test_types_and_digits_survive_the_stream(spark, tmp_path):
    schema = "`a key` string, ts timestamp, seq long, up boolean, big long, d decimal(20,4), x double, b binary, l array<string>, t timestamp_ntz"
    stamp = dt.datetime(2025, 1, 1, 0, 0, 0, 123457)
    rows = [("k", stamp + dt.timedelta(seconds=i), i, i % 2 == 1, None if i else 2**62 + 1, None, 0.1, b"\x00\xff", [None, "a"], stamp) for i in range(4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    finish(transition_stream(stream, out, ["a key"], interval=None, initial=False))
    assert sorted(map(str, stream_results(stream, out).collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[3]], schema).collect()))


def test_a_key_is_forgotten(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=i), i, up, False) for i, up in enumerate([False, True, False])]
    out = str(tmp_path / "out")
    stream = in_files(spark, str(tmp_path / "in"), [rows])
    query = transition_stream(stream, out, ["device"], interval="1 second", forget_after_seconds=2)

    def taken(n):  # such a stream is never out of work, so wait for its rows
        end = time.time() + 20
        while time.time() < end and sum(p.numInputRows for p in query.recentProgress) < n:
            time.sleep(0.2)

    try:
        taken(3)
        time.sleep(4)
        in_files(spark, str(tmp_path / "in"), [[(1, T0, 0, True, False), (1, T0 + dt.timedelta(seconds=9), 9, True, False)]])
        taken(5)
    finally:
        query.stop()
    # The later rows start the key anew, so neither is late and the first is only the baseline.
    assert results(spark, out) == [1] and results(spark, out, late_rows) == []


def test_keys_of_a_bucket_are_told_apart(monkeypatch):
    calls = []
    monkeypatch.setattr(ST, "_told", lambda found, late: calls.append((sorted(found), sorted(late))) or iter(()))

    class State:
        exists, hasTimedOut, value = False, False, None

        def update(self, value):
            self.exists, self.value = True, value

        @property
        def get(self):
            return self.value

    def rows(*items):
        return iter([pd.DataFrame(items, columns=["key", "t", "seq", "flag", "row"])])

    state, run = State(), ST._transitions(True, None)
    list(run((0,), rows(("a", 2, 0, True, "a2"), ("a", 1, 0, False, "a1"), ("b", 1, 0, True, "b1"), ("c", ST._NONE, 0, True, "c")), state))
    list(run((0,), rows(("b", 2, 0, False, "b2"), ("b", 3, 0, True, "b3"), ("a", 2, 0, True, "a2"), ("c", 1, 0, False, "c1")), state))
    list(run((0,), rows(("c", 2, 0, True, "c2"), ("a", 2, 1, False, "a3"), ("a", 2, 2, True, "a4")), state))
    assert calls == [(["a2"], ["c"]), (["b3"], ["a2"]), (["a4", "c2"], [])]
    assert len(pa.ipc.open_stream(state.value[0]).read_all()) == 3


def test_latest_stream(spark, tmp_path):
    rows, groups = ordered_groups(24, n=4)
    groups = [[(i, *r[1:]) for i in range(n)] + g for n, (r, g) in zip((30, 2, 1, 0), zip(rows, groups))]
    rows = [r for g in groups for r in g]
    out = str(tmp_path / "latest")
    stream = in_files(spark, str(tmp_path / "in"), groups[:1])

    def start():
        finish(T.start_latest(T.latest_stream(stream, ["device"], "ts", "seq"), out, str(tmp_path / "cp"), ["device"], None, buckets=8))

    def files():
        return {f for f in tmp_path.glob("latest/batch=*/bucket=*/*.parquet")}

    start()
    planned = T.read_latest(spark, out, SCHEMA)
    then = latest_by(spark.createDataFrame(groups[0], SCHEMA), ["device"], ["ts", "seq"]).collect()
    for g in groups[1:]:
        before = files()
        in_files(spark, str(tmp_path / "in"), [g])
        start()
        assert before <= files() and len(files() - before) <= len({r[0] for r in g}) < 8
    # A reader planned before three later batches still has its version.
    assert sorted(map(str, planned.collect())) == sorted(map(str, then))
    expected = latest_by(spark.createDataFrame(rows, SCHEMA), ["device"], ["ts", "seq"])
    assert sorted(map(str, T.read_latest(spark, out, SCHEMA).collect())) == sorted(map(str, expected.collect()))
    T._forget(spark, out, T._published(spark, out), 1)
    assert len(T._published(spark, out)) == 1
    assert sorted(map(str, T.read_latest(spark, out, SCHEMA).collect())) == sorted(map(str, expected.collect()))


def test_published_counter(spark, tmp_path):
    rows, groups = ordered_groups(25, n=3)
    counter = T.PublishedCounter()
    spark.streams.addListener(counter)
    try:
        stream = in_files(spark, str(tmp_path / "in"), groups).select(F.to_json(F.struct("seq")).alias("value"))
        finish(T.publish_stream(T.counted(stream), str(tmp_path / "cp"), "text", None, path=str(tmp_path / "topic")))
        assert counter.ended.wait(30)
    finally:
        spark.streams.removeListener(counter)
    assert list(counter.batches.values()) == [len(g) for g in groups] and counter.total == len(rows)
    assert spark.read.text(str(tmp_path / "topic")).count() == len(rows)


def test_ingest_publish_and_callback(spark, tmp_path):
    landing, table, topic = tmp_path / "landing", "ingested", str(tmp_path / "topic")
    spark.sql("DROP TABLE IF EXISTS ingested")
    landing.mkdir()
    cycles = []
    for i in range(2):
        lines = [HEADER, csv_line("1", "A", f"2025-10-1{i} 00:00:00", "LG6400", "1.5"), "1,A",
                 csv_line("2", "B", "garbage", "LG6400", "-1")]
        (landing / f"site{i}.csv").write_text("\n".join(lines) + "\n")
        readings = T.ingest_stream(spark, str(landing))
        finish(T.start_ingest(readings, table, str(tmp_path / "cp1"), None, path=str(tmp_path / "table")))
        messages = payload_stream(readings, F.lit("pi"), F.lit("192.0.2.1"))
        assert messages.columns == ["key", "value"]
        finish(T.publish_stream(messages, str(tmp_path / "cp2"), "text", None, path=topic))
        finish(T.on_batch(readings, lambda n, rows: cycles.append((n, rows.count())), str(tmp_path / "cp3"), None))
    stored = spark.table(table)
    assert stored.count() == 4 and stored.where("Time is null").count() == 2
    assert stored.where("quality = 'comm_failure'").count() == 2 and stored.select("site").distinct().count() == 2
    bodies = [json.loads(r.value) for r in spark.read.text(topic).collect()]
    assert len(bodies) == 4 and {b["meter_name"] for b in bodies} == {"A", "B"}
    assert cycles == [(1, 2), (2, 2)]
    parsed = read_payloads(spark, topic)
    assert parsed.isStreaming
    query = parsed.writeStream.format("parquet").option("path", str(tmp_path / "back")).option(
        "checkpointLocation", str(tmp_path / "cp4")).trigger(availableNow=True).start()
    finish(query)
    assert sorted(r.Meter_Name for r in spark.read.parquet(str(tmp_path / "back")).collect()) == ["A", "A", "B", "B"]


def test_stream_prune_stream_on(spark, tmp_path):
    now = dt.datetime(2025, 1, 20, 12)
    at = lambda hours: now - dt.timedelta(hours=hours)
    schema = "id int, Time timestamp_ntz, date date"
    spark.sql("DROP TABLE IF EXISTS kept")

    def arrive(rows):
        spark.createDataFrame([(i, t, t and t.date()) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        finish(T.start_ingest(stream, "kept", str(tmp_path / "cp"), None, path=str(tmp_path / "kept")))

    def ids():
        spark.catalog.refreshTable("kept")
        return sorted(r.id for r in spark.table("kept").collect())

    arrive([(i, at(12 * i)) for i in range(20)] + [(99, None)])
    arrive([(100 + i, at(12 * i + 1)) for i in range(20)])
    T.prune_table(spark, "kept", now)
    assert ids() == [*range(15), 99, *range(100, 114)]
    arrive([(200 + i, at(12 * i)) for i in range(20)])
    assert ids() == [*range(15), 99, *range(100, 114), *range(200, 220)]
    T.prune_table(spark, "kept", now)
    T.prune_table(spark, "kept", now)
    assert ids() == [*range(15), 99, *range(100, 114), *range(200, 215)]
    # A batch that runs again replaces what it has written.
    last = max(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())
    (tmp_path / "cp" / "commits" / f"{last}").unlink()
    (tmp_path / "cp" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    arrive([])
    assert ids() == [*range(15), 99, *range(100, 114), *range(200, 220)]
    spark.sql("DROP TABLE kept")


def test_prune_table(spark, tmp_path):
    now = dt.datetime(2025, 1, 20, 12)
    rows = [(i, now - dt.timedelta(hours=6 * i)) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, Time timestamp_ntz").withColumn("date", F.to_date("Time"))
    spark.sql("DROP TABLE IF EXISTS pruned")
    df.write.partitionBy("date").option("path", str(tmp_path / "pruned")).saveAsTable("pruned")
    T.prune_table(spark, "pruned", now)
    assert sorted(r.id for r in spark.table("pruned").collect()) == [*range(29), 99]
    T.prune_table(spark, "pruned", now + dt.timedelta(days=100))
    assert [r.id for r in spark.table("pruned").collect()] == [99]
    spark.sql("DROP TABLE pruned")
    assert T.prune_due(None, now) and T.prune_due(now, now + dt.timedelta(hours=1))
    assert not T.prune_due(now, now + dt.timedelta(minutes=59))
    assert PARAM_COLUMNS
