"""Physical plans: no cross or nested-loop joins, filters and columns reach the scan, no ordered window in one task."""

import re

import pytest

from wardline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gold_join", "chunk_parents", "latest_by_unit", "rate_limit", "chain_verify", "lineage_asof", "access_review", "retrieve_documents",
                                  "count_entities", "visible_rows", "name_scan_exact", "snapshot_diff", "routing_mix_daily", "profile" if "profile" in QUERIES else "load_profile"])
def test_no_cross_joins_and_no_single_task_windows(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert not re.search(r"Window \[.*\n.*\n?.*Exchange SinglePartition", p)


def test_columns_are_pruned(spark):
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(spark, "gold_join"))
    assert scans and all("l_extendedprice" not in s and "o_totalprice" not in s for s in scans)


def test_filters_are_pushed(spark):
    assert "EqualTo(event_type,signup)" in plan(spark, "lineage_asof") or "EqualTo(event_type, signup)" in plan(spark, "lineage_asof")


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "dedupe_latest")
