import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wattfleet import functions as W
from wattfleet.functions.payloads import payload_from_arrays
from wattfleet.operators import layout as L
from wattfleet.operators import manifest as M
from wattfleet.operators import quality as Q
from wattfleet.operators import registers as G
from wattfleet.operators import registry as R
from wattfleet.plans import tables as D
from wattfleet.schema import MODELS, PARAM_COLUMNS, READING_COLUMNS, register_map_long
from wattfleet.sources import files as S
from wattfleet.sources import payloads as P
from wattfleet.sources import readings as IO
from wattfleet.sources import registry as SR

HEADER = ",".join(READING_COLUMNS)


def wide(spark, cells, device="1", name="M1", time="2025-10-17 10:00:00", model="LG6400"):
    row = (device, name, time, model, *cells)
    return spark.createDataFrame([row], ", ".join(f"{c} string" for c in READING_COLUMNS))


def csv_line(device, name, time, model, fill):
    return ",".join([device, name, time, model, *[fill] * len(PARAM_COLUMNS)])


@pytest.fixture
def readings_folder(tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "PlantA.csv").write_text("\n".join([
        HEADER,
        csv_line("1", "A", "2025-10-11 00:00:00", "LG6400", "1.50"),
        csv_line("1", "A", "2025-10-10 23:59:59", "LG6400", "2"),
        csv_line("2", "B", "garbage", "ELR300", "NA"),
        "1,A",
        "",
        "3,C,2025-10-17 10:00:00",
        '1,"A,B"',
        csv_line("4", "D", "2025-10-17 10:00:00", "LG6400", "-1"),
    ]) + "\n")
    (folder / "Plant-B.csv").write_text(HEADER + "\n")
    return str(folder)


def test_read_prune_and_type(spark, readings_folder):
    bronze = IO.read_readings(spark, readings_folder)
    assert bronze.columns[:31] == READING_COLUMNS
    assert {r.site for r in bronze.select("site").distinct().collect()} == {"PlantA"}
    in_order = [r.Device_ID for r in bronze.orderBy("seq").collect()]
    assert in_order == ["1", "1", "2", "1", "3", "1", "4"]
    kept = Q.drop_malformed(bronze)
    assert sorted(r.Device_ID for r in kept.collect()) == ["1", "1", "2", "3", "4"]
    silver = Q.to_silver(kept)
    assert silver.schema["Time"].dataType.simpleString() == "timestamp_ntz"
    fresh = Q.retain(silver, dt.datetime(2025, 10, 18), days=7).collect()
    assert sorted(r.Device_ID for r in fresh) == [1, 2, 3, 4]
    by_id = {r.Device_ID: r for r in fresh}
    assert by_id[1].Watts_Total == 1.5 and by_id[2].Time is None and by_id[2].A_average is None
    assert by_id[4].quality == Q.COMM_FAILURE and by_id[4].Frequency is None
    assert by_id[3].quality == Q.OK


def test_retain_takes_a_scalar_frame_and_prunes_dates(spark, tmp_path):
    rows = [(i, dt.datetime(2025, 1, 1) + dt.timedelta(days=i)) for i in range(20)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, Time timestamp_ntz")
    as_of = df.agg(F.max("Time"))
    assert sorted(r.id for r in Q.retain(df, as_of, 7).collect()) == [12, 13, 14, 15, 16, 17, 18, 19, 99]
    path = str(tmp_path / "t")
    IO.write_readings(df, path)
    table = spark.read.parquet(path)
    fresh = Q.retain(table, dt.datetime(2025, 1, 20), 7, date="date")
    assert sorted(r.id for r in fresh.collect()) == [12, 13, 14, 15, 16, 17, 18, 19, 99]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(date" in plan


def test_write_appends_and_exports(spark, tmp_path):
    df = wide(spark, ["0.125"] * 27).withColumn("location", F.lit("Panel Room #1"))
    path = str(tmp_path / "csv")
    IO.export_readings(df.select(*READING_COLUMNS), path)
    IO.export_readings(df.select(*READING_COLUMNS), path)
    back = IO.read_readings(spark, path)
    assert back.count() == 2 and back.first().A_average == "0.12"
    by = str(tmp_path / "by")
    silver = Q.to_silver(df)
    IO.write_readings_by(silver, by, ["location_key", "date_key"])
    IO.write_readings_by(silver, by, ["location_key", "date_key"])
    assert (tmp_path / "by" / "location_key=PanelRoom1" / "date_key=20251017").is_dir()
    assert spark.read.option("header", True).csv(by).count() == 2


def test_layout(spark):
    raw = spark.createDataFrame([(1, 2)], ["Watts Total (kW)", "No. of x"])
    assert L.clean_columns(raw).columns == ["Watts_Total_kW", "No_of_x"]
    df = wide(spark, [str(i) for i in range(27)])
    shuffled = df.select(*reversed(df.columns))
    assert L.reading_layout(shuffled).columns == READING_COLUMNS
    assert L.drop_identity(df).columns == PARAM_COLUMNS
    nested = L.wide_to_struct(df).first()
    assert nested.device_id == "1" and nested.readings == ["2025-10-17 10:00:00", *[str(i) for i in range(27)]]
    long = L.wide_to_long(df, ["Device_ID"], PARAM_COLUMNS)
    assert {r.param: r.value for r in long.collect()} == {c: str(i) for i, c in enumerate(PARAM_COLUMNS)}


@pytest.mark.parametrize("cells,quality,unsupported", [
    (["-1"] * 27, "comm_failure", 0),
    (["0"] * 27, "no_response", 0),
    (["0"] * 26 + ["-1"], "ok", 0),
    (["NA"] * 25 + ["1.5", "2"], "ok", 25),
    (["NA"] * 27, "ok", 27),
])
def test_quality(spark, cells, quality, unsupported):
    row = Q.classify_quality(wide(spark, cells)).first()
    assert (row.quality, row.unsupported) == (quality, unsupported)


def test_quality_of_cells(spark):
    cells = Q.classify_cells(wide(spark, ["NA", "-1"] + ["5"] * 25), ["Device_ID"], PARAM_COLUMNS)
    got = {r.param: (r.value, r.quality) for r in cells.collect()}
    assert got["Watts_Total"] == (None, "unsupported") and got["Watts_R_Ph"] == (-1.0, "ok")
    failed = Q.classify_cells(wide(spark, ["-1"] * 27), ["Device_ID"], PARAM_COLUMNS)
    assert {(r.value, r.quality) for r in failed.collect()} == {(None, "comm_failure")}


def test_clock_skew(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, t, t + dt.timedelta(microseconds=u)) for i, u in enumerate([0, 2_000_000, 2_000_001, -2_000_001])]
    df = spark.createDataFrame(rows, "i int, a timestamp_ntz, b timestamp_ntz")
    got = {r.i: r.skewed for r in Q.clock_skew(df, "a", "b").collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}


OK, ERR, EXC = "ok", "error", "exception"


@pytest.mark.parametrize("attempts,outcome,words", [
    ({(1, 1): OK}, "ok", [11]),
    ({(1, 1): EXC}, "comm_failure", None),
    ({(1, 1): ERR, (1, 2): OK}, "ok", [12]),
    ({(1, 1): ERR, (1, 2): EXC}, "comm_failure", None),
    ({(1, 1): ERR, (1, 2): ERR}, "no_response", None),
    ({(1, 1): OK, (2, 1): OK}, "ok", [11, 21]),
    ({(1, 1): OK, (2, 1): EXC}, "comm_failure", None),
    ({(1, 1): ERR, (1, 2): ERR, (2, 1): EXC}, "comm_failure", None),
    ({(1, 1): ERR, (1, 2): ERR, (2, 1): ERR, (2, 2): EXC}, "no_response", None),
    ({(1, 1): ERR, (1, 2): OK, (2, 1): ERR, (2, 2): OK}, "ok", [12, 22]),
    ({(1, 1): OK, (2, 1): ERR, (2, 2): EXC}, "comm_failure", None),
    ({(1, 1): OK, (2, 1): ERR, (2, 2): ERR}, "no_response", None),
])
def test_attempts(spark, attempts, outcome, words):
    rows = [(7, b, a, s, [10 * b + a] if s == OK else None) for (b, a), s in attempts.items()]
    df = spark.createDataFrame(rows, "reading_id bigint, block int, attempt int, status string, words array<int>")
    got = G.resolve_attempts(df).first()
    assert (got.outcome, got.words, got.hours_outcome) == (outcome, words, None)


def dump(base, values, size=124):
    """Register words with the given (address, lo, hi)."""
    words = [0] * size
    for address, first, second in values:
        words[address - base], words[address - base + 1] = first, second
    return words


def test_registers_to_params(spark):
    full = dump(100, [(100, 32768, 17254), (156, 60293, 16967), (220, 1, 2), (228, 6, 53429)], 248)
    short = dump(100, [(100, 32768, 17254), (184, 32768, 17254), (220, 1, 2)], 124)
    rows = [
        (1, "LG6400", 100, full, "ok", None, None), (2, "EN8100", 100, full, "ok", None, None),
        (3, "LG+5220", 100, short, "ok", "ok", [0, 3661]), (4, "EN8410", 100, short, "ok", "no_response", None),
        (5, "LG+5310", 100, short, "ok", "comm_failure", None),
        (6, "ELR300", 148, [32768, 17254, 60293, 16967], "ok", None, None),
        (7, "LG6400", 100, None, "comm_failure", None, None), (8, "ELR300", 148, None, "no_response", None, None),
        (9, "other", 100, full, "ok", None, None),
    ]
    df = spark.createDataFrame(
        rows, "id int, model string, base int, words array<int>, outcome string, hours_outcome string, "
              "hours_words array<int>")
    got = {r.id: r for r in G.registers_to_params(df).collect()}
    assert got[1].Watts_Total == 230.5 and got[1].Frequency == 49.98
    assert got[1].No_of_interruption == 65538 and got[1].On_Hours == "124:04:05"
    assert tuple(got[2])[1:] == ("EN8100", *tuple(got[1])[2:])
    assert got[3].On_Hours == "01:01:01" and got[3].V_R_Harmonics is None and got[3].Watts_Total == 230.5
    assert got[4].On_Hours == "0" and got[4].V_R_Harmonics == 230.5
    assert got[5].On_Hours == "-1"
    assert got[6].A_average == 230.5 and got[6].A_R_Ph == 49.98 and got[6].Frequency is None
    assert set(tuple(got[7])[2:]) == {-1.0, "-1"} and set(tuple(got[8])[2:]) == {0.0, "0"}
    assert set(tuple(got[9])[2:]) == {0.0, "0"}
    text = {r.id: r for r in G.registers_to_text(df).collect()}
    assert text[6].Frequency == "NA" and text[6].A_average == "230.50" and text[7].Frequency == "-1"
    long = {(r.id, r.param): (r.value, r.quality) for r in G.registers_to_long(df).collect()}
    assert len(long) == 9 * 27
    assert long[1, "Watts_Total"] == (230.5, "ok") and long[1, "On_Hours"] == (446645.0, "ok")
    assert long[1, "No_of_interruption"] == (65538.0, "ok") and long[3, "On_Hours"] == (3661.0, "ok")
    assert long[3, "V_R_Harmonics"] == (None, "unsupported") and long[4, "On_Hours"] == (None, "no_response")
    assert long[5, "On_Hours"] == (None, "comm_failure") and long[6, "Frequency"] == (None, "unsupported")
    assert long[7, "On_Hours"] == (None, "comm_failure") and long[8, "A_average"] == (None, "no_response")
    assert long[9, "Frequency"] == (None, "no_response")
    plan = G.registers_to_params(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_register_map_long(spark):
    rows = register_map_long(spark).collect()
    assert len(rows) == len(MODELS) * 27
    by = {(r.model, r.param): r for r in rows}
    assert by["EN8410", "On_Hours"].addr == 230 and by["EN8410", "On_Hours"].kind == "hms"
    assert by["ELR300", "A_R_Ph"].addr == 150 and by["ELR300", "Frequency"].addr == 0


REGISTRY = """// devices of the site
{
  /* a block
     comment */
  "note": "see http://x/y // not a comment",
  "devices": {"not": "a list"},
  "meters": [
    {"meter_name":"M2","meter_address":"7","type":"X","site":"P"}, // first
    {"name":"","device_name":"D","device_id":3},
    "stray", 5, null,
    {"name":"A","address":null,"meter_address":9},
    {"name":"A","address":"x1"},
    {"name":"A","address":1,"model":"","type":"X","serial":"S \\"1\\" // x"},
    {}
  ]
}
"""


def test_registry(spark, tmp_path):
    (tmp_path / "Site 1.jsonc").write_text(REGISTRY)
    (tmp_path / "LG+5220 %41.jsonc").write_text("[]")
    (tmp_path / "list.jsonc").write_text('\n [{"name": "L", "address": 4, "model": "m", "location": ""}] // end')
    (tmp_path / "bad.jsonc").write_text('{"other": [1]}')
    (tmp_path / "worse.jsonc").write_text("[{")
    df = SR.read_registry(spark, str(tmp_path))
    rows = df.where("site = 'Site 1'").orderBy("pos").collect()
    assert [(r.name, r.address, r.model, r.location) for r in rows] == [
        ("M2", 7, "X", "P"), ("D", 3, "", "Unknown"), ("A", None, "", "Unknown"), ("A", None, "", "Unknown"),
        ("A", 1, "", "Unknown"), ("", None, "", "Unknown"),
    ]
    assert rows[4].extra == {"type": "X", "serial": 'S "1" // x'} and rows[3].extra["address"] == "x1"
    others = df.where("site <> 'Site 1'").collect()
    assert [(r.site, r.name, r.location) for r in others] == [("list", "L", "")]
    filled = {r.pos: r for r in R.registry_defaults(df.where("site = 'Site 1'")).collect()}
    assert (filled[5].name, filled[5].address) == ("Meter_6", 6)
    assert filled[2].address is None and filled[3].address is None
    edited = {r.pos: r for r in R.ui_defaults(df.where("site = 'Site 1'")).collect()}
    assert edited[5].address == 1 and edited[5].location == "" and edited[0].location == "P"


def test_site_names(spark, tmp_path):
    for name in ("LG+5220 x%41.csv", "plain", "two.dots.csv"):
        (tmp_path / name).write_text(HEADER + "\n1,A,t\n")
    got = {r.site for r in IO.read_readings(spark, str(tmp_path)).collect()}
    assert got == {"LG+5220 x%41", "plain", "two.dots"}


def test_order_of_a_file_survives_its_splits(spark, tmp_path):
    lines = [HEADER] + [csv_line(str(i), "A", "t", "m", "1") for i in range(4000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    for i in range(5):
        (tmp_path / f"small{i}.csv").write_text("\n".join(lines[:50]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = IO.read_readings(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        rows = df.select("site", "seq", "Device_ID").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for site in {r.site for r in rows}:
        ids = [int(r.Device_ID) for r in sorted((r for r in rows if r.site == site), key=lambda r: r.seq)]
        assert ids == list(range(4000 if site == "big" else 49))


def test_jsonc_text(spark, tmp_path):
    (tmp_path / "a.jsonc").write_text(REGISTRY)
    text = SR.read_jsonc(spark, str(tmp_path)).first().text
    assert json.loads(text)["note"] == "see http://x/y // not a comment"


def test_locations(spark):
    registry = spark.createDataFrame(
        [("P 1", 1), ("P 1", 2), ("P1", 3), ("Q", 4), (None, 5)], "location string, address int")
    assert {r.location: r.devices for r in R.location_counts(registry).collect()} == {"P 1": 2, "P1": 1, "Q": 1, None: 1}
    got = {(r.location, r.address, r.devices) for r in R.devices_per_location(registry).collect()}
    assert got == {("P 1", 1, 2), ("P 1", 2, 2), ("P1", 3, 1), ("Q", 4, 1), (None, 5, 1)}
    keys = R.distinct_locations(registry).collect()
    assert sorted((r.location_key, r.location) for r in keys if r.location) == [("P1", "P 1"), ("P1", "P1"), ("Q", "Q")]
    readings = spark.createDataFrame([("P1", 1), ("Z", 4)], "location_key string, address int")
    assert [r.location_key for r in R.known_locations(readings, registry).collect()] == ["P1"]
    joined = R.with_registry(readings, registry, ["address"], ["location"]).collect()
    assert {(r.address, r.location) for r in joined} == {(1, "P 1"), (4, "Q")}
    unknown = R.with_registry(readings.withColumn("address", F.lit(99)), registry, ["address"], ["location"])
    assert unknown.count() == 2 and unknown.first().location is None


def manifest(spark, rows):
    return spark.createDataFrame(rows, "path string, mtime bigint, size bigint")


def test_changed_files(spark):
    current = manifest(spark, [("new", 10, 5), ("same", 10, 5), ("later", 11, 5), ("earlier", 11, 5), ("size", 10, 6)])
    previous = manifest(spark, [("same", 10, 5), ("later", 10, 5), ("earlier", 12, 5), ("size", 10, 5), ("gone", 1, 1)])
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(M.changed_files(current, previous)) == ["earlier", "later", "new", "size"]
    assert names(M.changed_files(current, previous, "newer")) == ["later", "new", "size"]
    at_target = current.where("path <> 'same'").select("path")
    assert names(M.changed_files(current, previous, "newer", at_target=at_target)) == ["later", "new", "same", "size"]
    with pytest.raises(ValueError):
        M.changed_files(current, previous, "other")
    assert names(M.insert_only(current, previous)) == ["new"]
    after = M.upsert_manifest(previous, M.changed_files(current, previous))
    assert {r.path: (r.mtime, r.size) for r in after.collect()} == {
        "same": (10, 5), "later": (11, 5), "earlier": (11, 5), "size": (10, 6), "new": (10, 5), "gone": (1, 1)}
    assert [r.path for r in M.ordered_listing(current).collect()] == ["earlier", "later", "new", "same", "size"]
    assert names(M.settled_only(current, 70)) == ["new", "same", "size"]
    assert names(M.settled_only(current, current.agg(F.max("mtime") + 60))) == names(current)


def test_changed_files_per_target(spark):
    rows = [("usb1", "a", 1, 1), ("usb2", "a", 1, 1)]
    schema = "target string, path string, mtime bigint, size bigint"
    changed = M.changed_files(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:1], schema),
                              keys=["target", "path"])
    assert [(r.target, r.path) for r in changed.collect()] == [("usb2", "a")]


def test_file_listing_and_overwrite(spark, tmp_path):
    (tmp_path / "a.csv").write_text("12345")
    (tmp_path / "b.txt").write_text("x")
    listed = S.file_listing(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.size) for r in listed] == [("a.csv", 5)]
    assert listed[0].mtime == int((tmp_path / "a.csv").stat().st_mtime)
    target = str(tmp_path / "out")
    M.overwrite_all(spark.range(5), target)
    M.overwrite_all(spark.range(3), target)
    assert spark.read.parquet(target).count() == 3
    assert spark.read.options(**S.settled_options("2020-01-01T00:00:00")).schema("v string").csv(str(tmp_path)).count() == 0


def test_payload_golden(spark):
    df = spark.createDataFrame(
        [(["Time", "A"], ["2025-01-01 00:00:00", "1.5", "99"], "M", 4, "LG6400", None)],
        "names array<string>, vals array<string>, meter string, id int, model string, location string")
    text = df.select(payload_from_arrays(
        "names", "vals", F.col("meter"), F.lit("pi"), F.lit("192.0.2.1"), F.col("id"), F.col("model"),
        F.col("location"))).first()[0]
    assert json.loads(text) == {
        "Time": "2025-01-01 00:00:00", "A": "1.5", "pi_name": "pi", "pi_ip": "192.0.2.1", "meter_name": "M",
        "time": "2025-01-01 00:00:00", "device_id": "4", "model": "LG6400"}
    untimed = df.withColumn("names", F.array(F.lit("A"), F.lit("B")))
    keys = json.loads(untimed.select(payload_from_arrays(
        "names", "vals", F.col("meter"), F.lit("pi"), F.lit("ip"))).first()[0])
    assert set(keys) == {"A", "B", "pi_name", "pi_ip", "meter_name"}


def test_payload_round_trip(spark):
    silver = Q.to_silver(wide(spark, ["1.5"] * 20 + ["01:00:00"] + ["NA"] * 6)).withColumn("location", F.lit(None).cast("string"))
    message = P.build_payload(silver, F.lit("pi"), F.lit("192.0.2.1"))
    body = json.loads(message.first().value)
    assert body["Watts Total"] == 1.5 and body["Time"] == body["time"] == "2025-10-17 10:00:00"
    assert "location" not in body and "A B Harmonics" not in body and body["On Hours"] == "01:00:00"
    back = P.parse_payloads(message).first()
    assert (back.Device_ID, back.Meter_Name, back.Time, back.Watts_Total) == ("1", "M1", "2025-10-17 10:00:00", "1.5")
    broken = spark.createDataFrame([("nope",), ('{"time": "2025-01-01 00:00:00"}',)], "value string")
    assert [r.Time for r in P.parse_payloads(broken).collect()] == [None, "2025-01-01 00:00:00"]


def test_published_count(spark, tmp_path):
    df, seen = P.published_count(spark.range(7))
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get["messages"] == 7


def test_registry_texts_of_one_small_file_are_parsed_by_several_tasks(spark, tmp_path):
    rows = [(i, f"Customer {i}", "SEGMENT") for i in range(1, 201)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    texts = D.registry_texts(spark, str(tmp_path))
    sizes = [n for n in texts.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(sizes) > 1 and max(sizes) < 200 and sum(sizes) == 200
    plan = SR.parse_registry(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
