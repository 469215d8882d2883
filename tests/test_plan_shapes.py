"""Physical plans: nothing is joined all with all, scans read only what is asked for, aggregates start before the shuffle."""

from __future__ import annotations

import re

import pytest

from tributary.plans.catalogue import QUERIES

#: These ask for every pair, or have no equality to join by.
PAIRS = ("join_cross", "join_theta")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in (*PAIRS, "quality_report")])
def test_no_cartesian(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = plan_of(QUERIES["distinct"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<l_returnflag:string,l_linestatus:string>", plan)
    df = QUERIES["where_pred"](spark, sf_dir)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThan(l_quantity,45.0)" in plan and "EqualTo(l_returnflag,R)" in plan


def test_aggregates_are_partial_first(spark, sf_dir):
    for name in ("group_by", "rollup", "cube", "grouping_sets", "pivot", "distinct"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert plan.count("HashAggregate") >= 2 and plan.count("Exchange hashpartitioning") == 1, name


@pytest.mark.parametrize("name", ["asof_backward", "asof_forward", "asof_nearest"])
def test_as_of_is_a_window_not_a_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_top_k_is_one_operator(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_k"](spark, sf_dir))


def test_global_window_of_lateral_is_by_key(spark, sf_dir):
    assert "row_number() windowspecdefinition(o_custkey" in plan_of(QUERIES["lateral_top"](spark, sf_dir))


def test_no_python_in_plans(spark, sf_dir):
    for name in QUERIES:
        if name not in ("custom_udf", "quality_report", "table_function"):
            assert not re.search("Python|Pandas|Arrow", plan_of(QUERIES[name](spark, sf_dir))), name
