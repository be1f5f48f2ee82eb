"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# folds need pandas over groups; nothing else may
GROUPED_PANDAS = {"suppress_within_ttl", "reject_replays"}
# a classifier in batches: only texts go to Python and only labels come back
BATCHED = {"op8_language_id"}


def plan_of(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_joins_nor_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "PythonUDTF" not in plan
    assert name in BATCHED or "ArrowEvalPython" not in plan
    if name not in GROUPED_PANDAS:
        assert "InPandas" not in plan


@pytest.mark.parametrize("name", ["counter_delta", "open_incidents", "catchup_status", "reject_stale_tokens", "remediation_outcome"])
def test_scans_shuffle_rows_on_the_segment(spark, name):
    plan = plan_of(spark, name)
    assert re.search(r"hashpartitioning\([^)]*segment", plan)


def test_digest_needs_one_row_per_task(spark):
    plan = plan_of(spark, "lineitem_multiset_digest")
    assert plan.count("Exchange ") == 1 and "SinglePartition" in plan
    assert "partial_bit_xor" in plan and "SortAggregate" not in plan


def test_column_pruning(spark):
    scanned = re.search(r"FileScan parquet \[([^\]]*)\]", plan_of(spark, "lineitem_multiset_digest")).group(1)
    assert "l_orderkey" in scanned and "l_tax" not in scanned and "l_shipdate" not in scanned


def test_filters_reach_the_scan(spark):
    from fleetlens.adapters import table
    from fleetlens.operators.checks import worst_status

    results = table(spark, SF, "events").selectExpr("user_id AS monitor_id", "'ok' AS status", "event_type")
    plan = worst_status(results.filter("event_type = 'error'"), ["monitor_id"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    assert plan_of(spark, "top_processes").count("WindowGroupLimit") >= 2
