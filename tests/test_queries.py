"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry
from compare import connect, run

from wattfleet.plans.queries import ORACLES as SQL
from wattfleet.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    rows, _, problem = run(spark, sf_dir, name, QUERIES[name], SQL[name], con)
    assert problem is None and rows > 0


def test_entry(spark):
    first, again = entry.entry(spark), entry.entry(spark)
    assert first.schema == again.schema and first.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream")])
def test_no_plan_has_a_cross_join(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name,columns", [
    ("decode_float32", {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"}),
    ("cycles_per_device", {"user_id"}),
    ("classify_quality", {"event_id", "event_type"}),
])
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schema = re.search("ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {field.split(":")[0] for field in schema.split(",")} == columns


def test_transitions_shuffle_rows_once(spark, sf_dir):
    df = QUERIES["transitions_baseline"](spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in final and final.count("Exchange rangepartitioning") == 1 and final.count("Exchange hashpartitioning") == 1
