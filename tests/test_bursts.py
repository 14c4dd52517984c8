from __future__ import annotations

import random

import pytest
from sievelight.operators.bursts import burst_boundaries, dense_burst_index, frame_meta, group_bursts

SCHEMA = "session_id string, image_id long, time_ms long, has_subsec boolean, camera string, seq int"


def loop_bursts(frames, max_gap=600, min_run=3):
    """The rule as a loop over one session in capture order: id -> (pos, size) or None."""
    out, cameras = {}, {}
    for f in frames:
        cameras.setdefault(f[4], []).append(f)
    for members in cameras.values():
        runs, last = [], None
        for f in members:
            ok = f[2] is not None and f[5] != 0
            num = ok and (f[5] or 0) >= 1
            joins = False
            if last is not None and ok and last[1]:
                p, _, pnum = last
                limit = max_gap if f[3] and p[3] else max(max_gap, 1000)
                joins = abs(f[2] - p[2]) <= limit and (f[5] > p[5] if num and pnum else num == pnum)
            if joins:
                runs[-1][0].append(f)
            else:
                runs.append(([f], num))
            last = (f, ok, num)
        for run, num in runs:
            good = len(run) >= (2 if num else min_run)
            for i, f in enumerate(run):
                out[f[1]] = (i + 1, len(run)) if good else None
    return out


def grouped(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return group_bursts(df, ["session_id"], ["image_id"], **kw)


def sizes(spark, times, seqs=None, cameras=None, fine=True):
    rows = [("s", i, t, fine, cameras[i] if cameras else "X", seqs[i] if seqs else None) for i, t in enumerate(times)]
    got = grouped(spark, rows).where("burst_pos = 1").orderBy("image_id").collect()
    return [r.burst_size for r in got]


def test_literal_cases(spark):
    assert sizes(spark, [0] + [10000 + 50 * i for i in range(20)] + [60000], [0] + list(range(1, 21)) + [0]) == [20]
    assert sizes(spark, [0, 50, 750, 800], [1, 2, 3, 4]) == [2, 2]
    assert sizes(spark, [50 * i for i in range(8)] + [700 + 50 * i for i in range(5)], [*range(1, 9), *range(1, 6)]) == [8, 5]
    assert sizes(spark, [0, 100]) == []
    assert sizes(spark, [0, 100, 200]) == [3]
    assert sizes(spark, [0, 50, 100, 150], cameras=["X", "Y", "X", "Y"]) == []
    assert sizes(spark, [1000, 1000, 2000, 3000, 5000, 6000, 7000], fine=False) == [4, 3]
    assert sizes(spark, [0, 600, 1200]) == [3] and sizes(spark, [0, 601, 1202]) == []
    assert sizes(spark, [0, 10, 20], [5, 5, 5]) == [] and sizes(spark, [0, 10, 20], [1, 4, 9]) == [3]


def _random_sessions(n_sessions=60, seed=3):
    rng = random.Random(seed)
    rows, image = [], 0
    for s in range(n_sessions):
        t = 0
        for _ in range(rng.randrange(1, 40)):
            t += rng.choice([0, 50, 500, 600, 601, 900, 1000, 1001, 5000])
            rows.append((f"s{s}", image, None if rng.random() < 0.05 else t, rng.random() < 0.7,
                         rng.choice(["A", "A", "B", None]), rng.choice([None, None, 0, 1, 2, 3, 4, 5])))
            image += 1
    return rows


@pytest.mark.parametrize("slice_rows", [None, 5])
@pytest.mark.parametrize("min_run", [1, 3])
def test_random_against_loop(spark, sliced, slice_rows, min_run):
    rows = _random_sessions()
    want = {}
    for s in {r[0] for r in rows}:
        want.update(loop_bursts([r for r in rows if r[0] == s], min_run=min_run))
    if slice_rows:
        sliced(slice_rows)
    got = grouped(spark, rows, min_run=min_run).collect()
    assert {r.image_id: (r.burst_pos, r.burst_size) if r.burst_id else None for r in got} == want


def _loop_boundaries(groups):
    out = []
    for i, g in enumerate(groups):
        nxt = next((j for j in range(i + 1, len(groups)) if groups[j] is None or groups[j] != g), len(groups) - 1)
        head = lambda x: groups.index(x)
        if g is not None and head(g) < i:
            prv = head(g)
        elif i == 0:
            prv = 0
        else:
            prv = head(groups[i - 1]) if groups[i - 1] is not None else i - 1
        out.append((nxt + 1, prv + 1))
    return out


@pytest.mark.parametrize("slice_rows", [None, 6])
def test_boundaries_against_loop(spark, sliced, slice_rows):
    rng = random.Random(8)
    views = {f"s{k}": [rng.choice([None, "a", "a", "b", "c"]) for _ in range(rng.randrange(1, 25))] for k in range(50)}
    rows = [(s, i, g) for s, gs in views.items() for i, g in enumerate(gs)]
    if slice_rows:
        sliced(slice_rows)
    df = spark.createDataFrame(rows, "session_id string, image_id int, grp string")
    got = {(r.session_id, r.image_id): (r.next_boundary, r.prev_boundary)
           for r in burst_boundaries(df, ["session_id"], ["image_id"], "grp", "image_id").collect()}
    want = {(s, i): b for s, gs in views.items() for i, b in enumerate(_loop_boundaries(gs))}
    assert got == want


def test_dense_index_follows_first_frames(spark):
    # Two interleaved cameras: A starts first, B second, A again third.
    rows = [("s", i, t, True, c, None) for i, (t, c) in enumerate(
        [(0, "A"), (10, "B"), (20, "A"), (30, "B"), (40, "A"), (50, "B"), (9000, "A"), (9010, "A"), (9020, "A")])]
    got = dense_burst_index(grouped(spark, rows), ["session_id"], ["image_id"], "image_id").orderBy("image_id").collect()
    assert [r.burst_index for r in got] == [1, 2, 1, 2, 1, 2, 3, 3, 3]


def test_frame_meta(spark):
    df = spark.createDataFrame([("2021:04:05 17:41:23", "5", None, "M", 7), (None, None, "S", "M", None)],
                               "capture_time string, subsec string, serial string, model string, sequence_number int")
    a, b = frame_meta(df).collect()
    assert (a.time_ms % 1000, a.has_subsec, a.camera, a.seq) == (500, True, "M", 7)
    assert (b.time_ms, b.has_subsec, b.camera, b.seq) == (None, False, "S", None)
    assert a.time_ms == 1617644483500


def test_window_runs_are_shared(spark):
    """One shuffle of the frames serves all scans of the burst rule."""
    df = spark.createDataFrame(_random_sessions(3), SCHEMA)
    plan = group_bursts(df, ["session_id"], ["image_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan
