"""What the physical plans must look like."""

from conftest import FOLDER

from pacegrid.operators import reshape
from pacegrid.plans.laps import clock_laps
from pacegrid.queries import REGISTRY, feeds
from pacegrid.queries.base import Tables

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_are_broadcast(spark):
    plan = plan_of(REGISTRY["lookup_left_join"].run(spark, FOLDER))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(REGISTRY["filter_range"].run(spark, FOLDER))
    assert "LessThanOrEqual(o_totalprice,60000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_laps_are_exchanged_once(spark):
    plan = plan_of(clock_laps(feeds.laps(Tables(spark, FOLDER)), feeds.SEQUENCE, ["tr"]))
    assert plan.count("Exchange hashpartitioning") == 1


def test_top_k_limits_before_the_shuffle(spark):
    plan = plan_of(REGISTRY["top_k"].run(spark, FOLDER))
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2


def test_scaling_reads_its_statistics_once(spark):
    plan = plan_of(REGISTRY["zscore_global"].run(spark, FOLDER))
    assert "Window" not in plan and plan.count("Subquery") >= 1


def test_pivot_is_one_aggregation(spark):
    df = Tables(spark, FOLDER).lineitem
    plan = plan_of(reshape.pivot_measures(df, ["l_orderkey"], "l_returnflag", ["A", "N", "R"], ["l_tax"]))
    assert plan.count("Exchange") == 1
