"""What the physical plans must look like: no pair joins, pruned scans, pushed filters."""

from __future__ import annotations

import re

import oracle
import pytest

from sievelight.plans import QUERIES

# Building these runs streams or writes files.
RUNS_JOBS = {"write_sidecar_files", "copy_files", "watch_folder", "latest_state", "live_counts", "failure_ledger", "flush_barrier",
             "scan_files", "folders_opened", "edit_sidecars", "save_cache", "stream_bursts", "dedupe_requests", "late_edits", "coalesce_edits_span"}


def plan_of(spark, name):
    return QUERIES[name](spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_JOBS))
def test_no_pair_joins(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


@pytest.mark.parametrize("name,columns", [
    ("pick_counts", {"ts", "event_type"}),
    ("stored_bytes", {"source", "n_chars"}),
    ("load_progress", {"o_custkey", "o_orderstatus"}),
    ("number_batch", {"o_orderkey", "o_custkey", "o_orderdate"}),
    ("pick_grid_source", {"l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_tax"}),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    for schema in re.findall(r"ReadSchema: struct<(.*?)>\n?", plan_of(spark, name)):
        assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.mark.parametrize("name,pushed", [
    ("filter_pick", None), ("count_in_view", "GreaterThan(l_quantity,45.0)"), ("copy_failures", "EqualTo(o_orderstatus,P)"),
    ("select_all", "EqualTo(c_mktsegment,BUILDING)")])
def test_filters_reach_the_scan(spark, name, pushed):
    plan = plan_of(spark, name)
    assert pushed is None or any(pushed in f for f in re.findall(r"PushedFilters: \[(.*?)\]", plan)), plan
    assert pushed is not None or "Filter" in plan


def test_whole_table_order_never_meets_in_one_task(spark, sliced):
    """Anywhere in the plan, only summaries, one row per slice, may meet in one task."""
    sliced(100)
    lines = plan_of(spark, "lru_evict_pinned").splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
    assert below and all(re.search(r"HashAggregate\(keys=\[[^\]]*_slice#", line) for line in below), below
