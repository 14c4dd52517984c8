"""Every registered query against DuckDB on the driver tables, in one slice and in many."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
from sievelight.plans import ORACLES, QUERIES

# Queries whose plan holds lanes.
LANES = ["view", "view_descending", "provisional_order", "number_batch", "nearest_survivor", "extend_range", "group_bursts",
         "burst_position", "dense_burst_index", "burst_boundaries", "burst_days", "expand_template", "apply_template",
         "plan_copy", "plan_copy_template", "assign_free_suffix", "duplicate_names", "dedupe_output_names", "lru_evict",
         "lru_evict_pinned", "coalesce_edits"]


@pytest.fixture(scope="module")
def duck():
    return oracle.duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in ORACLES, "every query has a SQL check"
    assert oracle.compare(spark, duck, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", LANES)
def test_query_in_slices(spark, duck, sliced, name):
    sliced(20)
    assert oracle.compare(spark, duck, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "camera", "frames", "bursts", "frames_in_bursts", "longest", "share_picked"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
