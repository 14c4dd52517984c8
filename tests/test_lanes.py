"""Scans against plain loops, whole and in slices, with a group that holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators.lanes import Lanes, join_groups, last_seen, next_seen, position, previous, running, total


def _rows(n=900):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        # Two thirds of the rows share one key, some have none.
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((i, key, rng.choice([None, *range(12)]), rng.choice([None, rng.randrange(100)])))
    return rows


def _expected(rows, descending):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: (r[2] is None, r[2] or 0, r[0]), reverse=descending)
        acc, values = 0, [m[3] for m in members]
        for i, m in enumerate(members):
            acc += m[3] or 0
            before = [v for v in values[:i] if v is not None]
            after = [v for v in values[i + 1:] if v is not None]
            out[m[0]] = (i + 1, len(members), acc, values[i - 1] if i else None,
                         before[-1] if before else None, after[0] if after else None)
    return out


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("slice_rows", [None, 40, 7])
def test_scans(spark, sliced, descending, slice_rows):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, key string, at int, v int")
    if slice_rows:
        sliced(slice_rows)
    lane = Lanes(df, ["key"], ["at", "id"], descending)
    assert lane.sliced == bool(slice_rows)
    v = F.col("v")
    got = lane.scan(p=position(), n=total(), s=running(v), b=previous(v), l=last_seen(v), x=next_seen(v)).rows()
    assert got.columns == ["id", "key", "at", "v", "p", "n", "s", "b", "l", "x"]
    assert {r.id: (r.p, r.n, r.s, r.b, r.l, r.x) for r in got.collect()} == _expected(rows, descending)


def test_no_task_holds_the_hot_group(spark, sliced):
    df = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1000).cast("string")).alias("key"))
    sliced(100)
    lane = Lanes(df, ["key"], ["id"])
    sizes = lane.df.groupBy("key", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 400
    assert sizes.where("key = 'hot'").count() > 10


def test_small_groups_stay_whole(spark, sliced):
    sliced(100)
    assert not Lanes(spark.range(1000).withColumn("key", F.col("id") % 50), ["key"], ["id"]).sliced


def test_plain_window_until_the_input_is_large(spark):
    lane = Lanes(spark.range(1000).withColumn("key", F.lit(1)), ["key"], ["id"])
    assert not lane.sliced


def test_join_groups_matches_null_keys_and_keeps_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "k") for i in range(50)], "id int, key string")
    groups = spark.createDataFrame([(None, 1), ("k", 2), ("unused", 3)], "key string, x int")
    got = join_groups(rows, groups, ["key"], ["id"]).collect()
    assert sorted((r.id, r.x) for r in got) == [(i, 1 if i % 2 else 2) for i in range(50)]
