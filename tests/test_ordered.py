"""Operators along the order of a device's rows, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattfleet.operators import cooldown as C
from wattfleet.operators.cooldown import throttle
from wattfleet.operators.cycles import cycle_counts, cycle_every, number_cycles
from wattfleet.operators.latest import latest_by, latest_per_device, latest_source, tail_n, union_sites
from wattfleet.operators.scan import in_order
from wattfleet.operators.transitions import transitions

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "device int, ts timestamp_ntz, seq bigint, up boolean, force boolean"


def seconds(values):
    return [T0 + dt.timedelta(seconds=v) for v in values]


def random_events(seed, n=600, span=20_000, with_null_times=True):
    """Three keys, one of them null and one holding most rows; repeated times; some rows without a time."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        device = rng.choices([1, None, 2], [6, 2, 1])[0]
        offset = rng.choice([rng.randrange(span), rng.randrange(0, span, 500), 7777])
        ts = None if with_null_times and rng.random() < 0.05 else T0 + dt.timedelta(seconds=offset)
        rows.append((device, ts, seq, rng.random() < 0.5, rng.random() < 0.03))
    rng.shuffle(rows)
    return rows


def histories(rows):
    keyed = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        keyed.setdefault(row[0], []).append(row)
    return keyed


@pytest.fixture
def partitions(spark):
    """Sets the number of partitions that rows are ordered in."""
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    yield lambda n: spark.conf.set(setting, str(n))
    spark.conf.set(setting, before)


@pytest.mark.parametrize("seed,parts", [(1, 8), (2, 1), (3, 60), (4, 3)])
def test_number_cycles(spark, partitions, seed, parts):
    partitions(parts)
    rows = random_events(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["seq"]: r["cycle"] for r in number_cycles(df, ["device"], "ts", "seq").collect()}
    expected = {r[2]: i for h in histories(rows).values() for i, r in enumerate(h, 1)}
    assert got == expected
    every = cycle_every(df, 10, ["device"], "ts", "seq").select("seq").collect()
    assert {r[0] for r in every} == {s for s, i in expected.items() if i % 10 == 0}
    counts = {r["device"]: r["cycles"] for r in cycle_counts(df, ["device"]).collect()}
    assert counts == {k: len(h) for k, h in histories(rows).items()}


def copies(n=900):
    """A third of all rows are copies: one device, one time; the rest is spread."""
    rows = random_events(6, n=n, with_null_times=False)
    return [(1, T0, *r[2:]) if i % 3 == 0 else r for i, r in enumerate(rows)]


@pytest.mark.parametrize("same", ["time", "row"])
def test_a_crowded_device_is_spread(spark, same):
    row = (1, T0, 5, True, False)
    rows = [row] * 2000 + random_events(6, n=1000) if same == "row" else copies(3000)
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = [r["count"] for r in in_order(df, ["device"], "ts", "seq").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    if same == "row":
        numbers = sorted(r["cycle"] for r in number_cycles(df.where("seq = 5 and up and ts = timestamp_ntz'2025-01-01'"), ["device"], "ts", "seq").collect())
        assert numbers == list(range(1, len(numbers) + 1)) and len(numbers) >= 2000


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_a_third_of_rows_as_copies(spark, partitions, batch):
    rows = copies()
    df = spark.createDataFrame(rows, SCHEMA)
    partitions(25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["seq"]: r["cycle"] for r in number_cycles(df, ["device"], "ts", "seq").collect()}
        assert got == {r[2]: i for h in histories(rows).values() for i, r in enumerate(h, 1)}
        edges = transitions(df, ["device"]).collect()
        expected = [b[2] for h in histories(rows).values() for a, b in zip(h, h[1:]) if b[3] and not a[3]]
        assert sorted(r["seq"] for r in edges) == sorted(expected)
        for bypass in (None, "force"):
            fired = throttle(df, ["device"], 600, bypass=bypass).collect()
            assert sorted(r["seq"] for r in fired) == sorted(brute_throttle(rows, 600, bypass is not None))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("initial", [None, False, True])
@pytest.mark.parametrize("seed,parts", [(1, 8), (2, 100), (3, 1)])
def test_transitions(spark, partitions, seed, parts, initial):
    partitions(parts)
    rows = random_events(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = transitions(df, ["device"], initial=initial).collect()
    expected = set()
    for history in histories(rows).values():
        before = True if initial is None else initial
        for row in history:
            if row[3] and not before:
                expected.add(row[2])
            before = row[3]
    assert sorted(r["seq"] for r in got) == sorted(expected)
    assert got[0].__fields__ == df.columns


def test_ordered_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA + ", cycle int")
    assert number_cycles(df, ["device"], "ts", "seq").columns == [*df.columns[:-1], "cycle"]
    for found in (number_cycles(df, ["device"], "ts", "seq"), transitions(df, ["device"]), throttle(df, ["device"], 60)):
        assert found.count() == 0


def test_transitions_golden(spark):
    samples = "TFFTTFT"
    df = spark.createDataFrame(
        [("net", t, i, s == "T") for i, (t, s) in enumerate(zip(seconds(range(0, 7000, 1000)), samples), 1)],
        "key string, ts timestamp_ntz, seq bigint, up boolean",
    )
    assert sorted(r["seq"] for r in transitions(df, ["key"]).collect()) == [4, 7]
    assert sorted(r["seq"] for r in transitions(df, ["key"], initial=False).collect()) == [1, 4, 7]


def brute_throttle(rows, cooldown, use_bypass, failing=()):
    fired = set()
    for history in histories(rows).values():
        last = None
        for _, ts, seq, _, force in history:
            if ts is None:
                continue
            if last is None or (use_bypass and force) or (ts - last).total_seconds() >= cooldown:
                fired.add(seq)
                last = last if seq in failing else ts
    return fired


@pytest.mark.parametrize("bypass", [None, "force"])
@pytest.mark.parametrize("seed,cooldown,parts", [(1, 600, 8), (2, 600, 1), (3, 90, 40), (4, 5000, 90), (5, 0, 8), (6, 50_000, 30), (7, 0.5, 8)])
def test_throttle(spark, partitions, seed, cooldown, parts, bypass):
    partitions(parts)
    rows = random_events(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = throttle(df, ["device"], cooldown, bypass=bypass)
    assert got.columns == df.columns
    got = got.collect()
    assert sorted(r["seq"] for r in got) == sorted(brute_throttle(rows, cooldown, bypass is not None))
    by_seq = {r[2]: r for r in rows}
    assert all(tuple(r) == by_seq[r["seq"]] for r in got)


def test_throttle_over_many_batches(spark, partitions):
    rows = random_events(8, n=3000, with_null_times=False)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for cooldown, parts in [(600, 2), (40, 8), (3000, 50)]:
            partitions(parts)
            got = throttle(df, ["device"], cooldown, bypass="force").collect()
            assert sorted(r["seq"] for r in got) == sorted(brute_throttle(rows, cooldown, True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("parts,batch,bypass", [(1, "10000", None), (30, "10000", "force"), (8, "5", None), (40, "3", "force")])
def test_a_failed_action_starts_no_cooldown(spark, partitions, parts, batch, bypass):
    partitions(parts)
    rows = random_events(10)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("done", F.when(F.col("seq") % 7 == 0, None).otherwise(F.col("seq") % 3 != 0))
    failing = {r[2] for r in rows if r[2] % 7 == 0 or r[2] % 3 == 0}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = throttle(df, ["device"], 900, bypass=bypass, success="done").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["seq"] for r in got) == sorted(brute_throttle(rows, 900, bypass is not None, failing))


def test_throttle_golden(spark):
    def fires(offsets, forced=()):
        df = spark.createDataFrame(
            [(1, t, i, True, o in forced) for i, (o, t) in enumerate(zip(offsets, seconds(offsets)))], SCHEMA
        )
        got = throttle(df, ["device"], 600, bypass="force").collect()
        return sorted(int((r["ts"] - T0).total_seconds()) for r in got)

    assert fires([0, 100, 600, 700, 1199, 1200]) == [0, 600, 1200]
    assert fires([0, 100, 600, 700, 1199, 1200, 1299, 1300], forced=[100]) == [0, 100, 700, 1300]


def test_step_functions_compose():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        cooldown = int(rng.integers(1, 40))
        ts = np.sort(rng.integers(0, 100, n)).astype(np.int64)
        bypass = rng.random(n) < 0.1
        cut = int(rng.integers(1, n))
        joined = C.compose(
            C.step_function(ts[:cut], bypass[:cut], cooldown),
            C.step_function(ts[cut:], bypass[cut:], cooldown),
            cooldown,
            int(ts[0]) + cooldown,
        )
        whole = C.step_function(ts, bypass, cooldown)
        states = np.array([C.NEVER, *range(int(ts[0]) - 50, int(ts[0]) + 1)])
        expected = []
        for state in states.tolist():
            for t, forced in zip(ts.tolist(), bypass.tolist()):
                if forced or state == C.NEVER or t - state >= cooldown:
                    state = t
            expected.append(state)
        assert C.apply_steps(*joined, states, cooldown).tolist() == expected
        assert C.apply_steps(*whole, states, cooldown).tolist() == expected


def test_latest_golden(spark):
    at = lambda minute: dt.datetime(2025, 1, 1, 10, minute)
    df = spark.createDataFrame(
        [(1, 7, at(0)), (2, 7, at(5)), (3, 8, at(1)), (4, 7, at(5)), (5, 9, None), (6, 8, None)],
        "seq bigint, Device_ID int, Time timestamp_ntz",
    )
    expected = {7: 4, 8: 3, 9: 5}
    assert {r.Device_ID: r.seq for r in latest_per_device(df, ["Device_ID"]).collect()} == expected
    assert {r.Device_ID: r.seq for r in latest_by(df, ["Device_ID"], ["Time", "seq"]).collect()} == expected


def test_latest_forms_agree_on_random_rows(spark):
    df = spark.createDataFrame(random_events(11), SCHEMA)
    a = latest_per_device(df, ["device"], "ts", "seq").collect()
    b = latest_by(df, ["device"], ["ts", "seq"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 3


def test_latest_is_ranked_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = latest_per_device(df, ["user_id"], "ts", "event_id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_tail_union_and_source(spark):
    a = spark.range(100).withColumn("x", F.lit("a"))
    assert [r.id for r in tail_n(a, ["id"]).collect()] == list(range(50, 100))
    both = union_sites([a, spark.range(3).withColumn("y", F.lit(1))])
    assert both.columns == ["id", "x", "y"] and both.count() == 103
    files = spark.createDataFrame([("s", "a", 5), ("s", "b", 9), ("t", "c", 9)], "site string, path string, mtime bigint")
    assert latest_source(files).first().asDict() == {"path": "c", "mtime": 9}
    assert {r.site: r.path for r in latest_source(files, ["site"]).collect()} == {"s": "b", "t": "c"}
