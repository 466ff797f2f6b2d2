"""Queries of operators that are to use DataFrame operations only."""

import pytest

from wattfleet.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op3_chat", "op4_decontaminate", "op7_licenses", "op8_personal_data"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op4_decontaminate", "op7_licenses", "op11_repair", "op13_top_k"])
def test_no_cross_join_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
