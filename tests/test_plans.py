"""Physical plans: what must not be in them, and what must."""

import re

import pytest

from railpulse.plans.catalogue import all_queries
from railpulse.operators import failures, quality
from railpulse.sources.star import StarTables

FOLDER = "/root/testdata/sf0.001"
# Queries that write files or run a stream to get their rows.
RUNS = {"publish_dims"} | {name for name in all_queries() if "stream" in name}
BATCH = sorted(set(all_queries()) - RUNS)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_pairs(spark, name):
    plan = plan_of(all_queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow", "CollectLimit"):
        assert node not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(failures.failure_reasons(StarTables(spark, FOLDER).transactions(), StarTables(spark, FOLDER).error_codes()))
    assert re.search(r"ReadSchema: struct<event_id:bigint,event_type:string>", plan)
    assert re.search(r"DataFilters: \[.*event_type", plan)


def test_top_k_needs_no_full_sort(spark):
    plan = plan_of(all_queries()["bank_pair_matrix"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan


def _final(df) -> str:
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


def test_groups_are_computed_once(spark):
    star = StarTables(spark, FOLDER)
    plan = _final(failures.failure_breakdown(star.transactions(), star.error_codes()))
    assert plan.count("FileScan") == 1


def test_funnel_reads_the_stages_once(spark):
    plan = plan_of(all_queries()["funnel"](spark, FOLDER))
    assert plan.count("lineitem.parquet") == 1


def test_audit_shuffles_valid_rows_once(spark):
    plan = _final(quality.dq_audit_summary(StarTables(spark, FOLDER).raw_transactions()))
    assert plan.count("FileScan") == 2 and "ReusedExchange" in plan


def test_retries_without_hot_users_are_one_window(spark):
    plan = _final(all_queries()["retry_policy_day"](spark, FOLDER))
    assert plan.count("FileScan") == 1 and "Union" not in plan
