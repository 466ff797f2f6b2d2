import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattfleet import functions as W


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_format_value_text(spark):
    golden = {
        "0": "0", "0.0": "0", "-0.0": "0", "00": "0", "1.50": "1.50", "-1": "-1", "NA": "NA", "nan": "nan",
        "1_000": "1000", "1.5d": "1.5d", "123:04:05": "123:04:05", "-0.001": "-0.00", " 7 ": "7", "": "",
        "1e3": "1000", ".5": "0.50", "abc ": "abc ", "1__0": "1__0", "-2.345e1": "-23.45",
    }
    assert column(spark, list(golden), "string", W.format_value) == list(golden.values())


def test_format_value_double(spark):
    golden = [
        (0.0, "0"), (5.0, "5"), (0.125, "0.12"), (0.375, "0.38"), (2.625, "2.62"), (1234.5, "1234.50"),
        (-1.0, "-1"), (-0.001, "-0.00"), (float("inf"), "inf"), (float("nan"), "nan"), (4294967295.0, "4294967295"),
        (1e15, "1000000000000000"),
    ]
    assert column(spark, [g[0] for g in golden], "double", W.format_value) == [g[1] for g in golden]


def test_format_value_eighths_match_python(spark):
    values = [k / 8 for k in range(-400, 400)]
    expected = [str(int(v)) if v == int(v) else f"{v:.2f}" for v in values]
    assert column(spark, values, "double", W.format_value) == expected


@pytest.mark.parametrize("lo,hi,out", [
    (32768, 17254, 230.5), (60293, 16967, 49.98), (0, 49024, -1.0), (0, 15872, 0.12), (0, 0, 0.0), (714, 0, 0.0),
    (0, 32640, float("inf")), (0, 65408, float("-inf")),
])
def test_decode_float32(spark, lo, hi, out):
    df = spark.createDataFrame([(lo, hi)], "lo int, hi int")
    assert df.select(W.decode_float32("lo", "hi")).first()[0] == out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False, min_value=-2**40, max_value=2**40),
                min_size=50, max_size=200))
def test_decode_float32_against_struct(spark, numbers):
    rows = []
    for i, number in enumerate(numbers):
        hi, lo = struct.unpack(">HH", struct.pack(">f", number))
        rows.append((i, lo, hi))
    df = spark.createDataFrame(rows, "i int, lo int, hi int")
    got = [r[0] for r in df.orderBy("i").select(W.decode_float32("lo", "hi")).collect()]
    assert got == [round(n, 2) for n in numbers]


def test_decode_nan(spark):
    df = spark.createDataFrame([(1, 32640)], "lo int, hi int")
    value = df.select(W.decode_float32("lo", "hi")).first()[0]
    assert value != value


def test_pack_u32(spark):
    df = spark.createDataFrame([(1, 2), (0, 0), (65535, 65535)], "hi int, lo int")
    assert [r[0] for r in df.select(W.pack_u32("hi", "lo")).collect()] == [65538, 0, 4294967295]


def test_hms_round_trip(spark):
    seconds = [0, 1, 59, 60, 3599, 3600, 3661, 446645, 4294967295]
    text = column(spark, seconds, "bigint", W.seconds_to_hms)
    assert text[0] == "00:00:00" and text[6] == "01:01:01" and text[7] == "124:04:05"
    assert column(spark, text, "string", W.hms_to_seconds) == seconds
    assert column(spark, ["x", "1:2", "NA", "-1", None, "1:60:00"], "string", W.hms_to_seconds) == [None] * 6


def test_sanitize_key(spark):
    got = column(spark, ["Panel Room #1-a_b", "Pänel", "A B", "AB", "Raum ٣/x"], "string", W.sanitize_key)
    assert got == ["PanelRoom1-a_b", "Pänel", "AB", "AB", "Raum٣x"]


def test_parse_reading_time(spark):
    values = ["2025-10-11 00:00:00", "2025-1-2 3:4:5", "garbage", "2025-02-30 00:00:00", "25-01-01 00:00:00", None,
              "2025-01-01", "2025-01-01 24:00:00"]
    got = column(spark, values, "string", W.parse_reading_time)
    assert [g and g.isoformat(" ") for g in got] == ["2025-10-11 00:00:00", "2025-01-02 03:04:05"] + [None] * 6
    days = column(spark, values[:1], "string", lambda c: W.date_key(W.parse_reading_time(c)))
    assert days == ["20251011"]


def test_json_path(spark):
    doc = ('{"usb": {"enabled": true, "n": 600, "name": "x", "obj": {"a": 1}, "list": [1], "none": null, '
           '"text": "{1}", "f": 1.5, "empty": ""}}')
    df = spark.createDataFrame([(doc,)], "v string")
    expected = {"usb.enabled": "true", "usb.n": "600", "usb.name": "x", "usb.obj": "", "usb.obj.a": "1", "usb.list": "",
                "usb.none": "", "usb.text": "{1}", "usb.f": "1.5", "usb.missing": "", "nope.x": "", "usb.empty": "",
                "usb.n.deeper": ""}
    row = df.select(*[W.json_path("v", p).alias(str(i)) for i, p in enumerate(expected)]).first()
    assert list(row) == list(expected.values())
    assert column(spark, ["not json", None], "string", lambda c: W.json_path(c, "a")) == ["", ""]


def test_zip_params(spark):
    df = spark.createDataFrame(
        [(["Time", "A"], ["t", "1", "99"]), (["A", "B", "A"], ["1", "2", "3"]), (["A", "B"], ["1"]), ([], ["1"])],
        "names array<string>, vals array<string>",
    )
    got = [r[0] for r in df.select(W.zip_params("names", "vals")).collect()]
    assert got == [{"Time": "t", "A": "1"}, {"B": "2", "A": "3"}, {"A": "1"}, {}]


def test_integers(spark):
    assert column(spark, ["7", " 8 ", "x1", "1.5", "", None, "99999999999", "1_0"], "string", W.to_integer) == [
        7, 8, None, None, None, None, None, 10]


def test_format_value_of_any_size(spark):
    big = [1e15, 2.0**53, 2.0**62, 2.0**63, 2.0**64, 1e20, 2.0**70, 1.5e38, 3e38, 3.4e38, 1e39, 1e300]
    values = [v for b in big for v in (b, -b)]
    assert column(spark, values, "double", W.format_value) == [str(int(v)) for v in values]
