"""A drained stream equals the batch form, replays change nothing, and late rows undo nothing."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelight.operators.bursts import group_bursts
from sievelight.streaming import edits as E
from sievelight.streaming import live as L
from sievelight.streaming.tables import FailureLedger, LateRows, StateTable

SCHEMA = "seq long, ts timestamp, path string, kind string, pick string, keywords array<string>, fields struct<title:string>"
START = datetime(2026, 7, 26, 10, tzinfo=timezone.utc)


def edit(seq, ms, path, kind, value=None):
    return (seq, START + timedelta(milliseconds=ms), path, kind, value if kind == "mark" else None,
            value if kind == "keywords" else (["iptc"] if kind == "iptc" else None), (value,) if kind == "iptc" else None)


def edits(spark, *rows):
    return spark.createDataFrame([edit(i, *r) for i, r in enumerate(rows)], SCHEMA)


def writes(df):
    return {(r.path, r.slot, r.last_seq): (r.pick, r.keywords, r.fields and r.fields.title, r.sets_fields, r.edits) for r in df.collect()}


def test_debounce_rules(spark):
    got = writes(E.coalesce_edits(edits(
        spark, (0, "a", "mark", "Picked"), (100, "a", "mark", "Rejected"), (799, "a", "mark", "Picked"),  # one write
        (1500, "a", "mark", "Rejected"),  # more than 700 ms later: another
        (0, "b", "iptc", "t"), (50, "b", "keywords", ["k"]), (60, "b", "mark", "Picked"),
        (0, "c", "keywords", ["k"]), (50, "c", "iptc", "t2"), (0, "d", "keywords", ["only"]))))
    assert got == {
        ("a", "pick", 2): ("Picked", None, None, False, 3), ("a", "pick", 3): ("Rejected", None, None, False, 1),
        ("b", "metadata", 5): (None, ["k"], "t", True, 2), ("b", "pick", 6): ("Picked", None, None, False, 1),
        ("c", "metadata", 8): (None, ["iptc"], "t2", True, 2), ("d", "metadata", 9): (None, ["only"], None, False, 1)}


def _random_edits(spark, n=400):
    rng = random.Random(9)
    t, rows = 0, []
    for _ in range(n):
        t += rng.choice([10, 100, 400, 900])
        rows.append((t, rng.choice("ab" * 3 + "c"), *rng.choice([("mark", "Picked"), ("mark", "Rejected"), ("keywords", ["x"]), ("iptc", "t")])))
    return edits(spark, *rows)


def _stream(spark, df, folder, parts):
    """The rows as a file stream, one file per time slice, in order."""
    rank = F.ntile(parts).over(Window.orderBy("ts"))
    for i, part in enumerate(sorted(r[0] for r in df.select(rank).distinct().collect())):
        df.withColumn("_p", rank).where(F.col("_p") == part).drop("_p").coalesce(1).write.parquet(f"{folder}/in/p={i:03}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def _run(stream, folder, mode="append"):
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    run.outputMode(mode).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("slice_rows", [None, 15])
def test_stream_debounce_equals_batch(spark, sliced, tmp_path, slice_rows):
    log = _random_edits(spark)
    if slice_rows:
        sliced(slice_rows)
    want = writes(E.coalesce_edits(log))
    # A last edit far ahead moves the watermark past every open pause.
    sentinel = spark.createDataFrame([edit(9999, 10**8, "end", "mark", "Picked")], SCHEMA)
    stream = E.coalesce_edits(_stream(spark, log.unionByName(sentinel), str(tmp_path), 5))
    _run(stream, str(tmp_path))
    assert writes(spark.read.parquet(f"{tmp_path}/out")) == want


@pytest.mark.parametrize("slice_rows", [None, 15])
def test_writes_of_a_path_edited_without_pause(spark, sliced, tmp_path, slice_rows):
    """A run is cut at each second after its first edit: batch, stream and a loop agree."""
    log = _random_edits(spark).unionByName(edits(spark, *[(10 * k, "busy", "mark", "Picked" if k % 3 else "Rejected") for k in range(500)]).withColumn(
        "seq", F.col("seq") + 1000))
    want, runs = set(), {}
    for r in sorted(log.collect(), key=lambda r: (r.ts, r.seq)):
        key = (r.path, "pick" if r.kind == "mark" else "metadata")
        first, last = runs.get(key, (None, None))
        if last is None or (r.ts - last) > timedelta(milliseconds=700):
            first = r.ts
        runs[key] = (first, r.ts)
        want.add((*key, first, (r.ts - first) // timedelta(seconds=1)))
    if slice_rows:
        sliced(slice_rows)
    batch = E.coalesce_edits(log, max_span_ms=1000)
    expected = {(r.path, r.slot, r.last_seq, r.write_at): w for r, w in ((r, (r.pick, r.keywords, r.fields and r.fields.title, r.sets_fields, r.edits)) for r in batch.collect())}
    assert len(expected) == len(want) and sum(w[4] for w in expected.values()) == log.count()
    assert sum(k[0] == "busy" for k in expected) == 5
    ends = spark.createDataFrame([edit(9998, 10**8, "end", "mark", "Picked"), edit(9999, 10**9, "end", "mark", "Picked")], SCHEMA)
    _run(E.coalesce_edits(_stream(spark, log.unionByName(ends), str(tmp_path), 5), max_span_ms=1000), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out").where("path <> 'end'").collect()
    assert {(r.path, r.slot, r.last_seq, r.write_at): (r.pick, r.keywords, r.fields and r.fields.title, r.sets_fields, r.edits) for r in got} == expected
    assert len(got) == len(expected)


def test_burst_windows_join_at_exactly_the_gap(spark):
    at = lambda ms: (START + timedelta(milliseconds=ms),)
    df = spark.createDataFrame([at(0), at(600), at(1200), at(1801)], "ts timestamp").withColumn("c", F.lit(1))
    assert [r.burst_size for r in L.burst_windows(df, ["c"]).collect()] == [3]


def _expected_state(rows):
    state = {}
    for r in sorted(rows, key=lambda r: r.seq):
        pick, kw, title = state.get(r.path, ("Unmarked", None, None))
        state[r.path] = (r.pick if r.kind == "mark" else pick, kw if r.kind == "mark" else r.keywords,
                         r.fields.title if r.kind == "iptc" else title)
    return state


def _state(df):
    return {r.path: (r.pick, r.keywords, r.fields and r.fields.title) for r in E.current_state(df).collect()}


def test_state_table_replay_and_late_edits(spark, tmp_path):
    log = _random_edits(spark).cache()
    want = _expected_state(log.collect())
    table = StateTable(spark, str(tmp_path / "state"), log.schema, buckets=3)
    assert table.read().count() == 0
    parts = [log.where(F.col("seq") % 3 == k) for k in (2, 0, 1)]  # old edits come after newer ones
    for i, part in enumerate(parts):
        table.upsert(part, i)
        table.upsert(part, i)  # the batch runs again
    assert _state(table.read()) == want
    picks = [p for p, _, _ in want.values()]
    assert table.live_counts().first().asDict() == {
        "all": len(picks), **{s.lower(): picks.count(s) for s in ("Picked", "Rejected", "Unmarked")}}


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=s)) for i, s in enumerate([0, 50, 10, 100, 39, 40, 41, 99, 300, 239, 240])]
    df = spark.createDataFrame(rows, "n int, ts timestamp")
    split = LateRows(spark, str(tmp_path / "split"), df.schema, delay_ms=60_000)
    assert split.late().count() == 0
    batches = [(0, 1, 2), (3, 4), (5, 6), (), (7, 8), (9, 10)]
    for _ in range(2):  # all batches run again
        for i, some in enumerate(batches):
            split.append(df.where(F.col("n").isin(*some)) if some else df.limit(0), i)
    seen, late = None, set()
    for some in batches:
        late |= {n for n in some if seen is not None and rows[n][1] < seen - timedelta(seconds=60)}
        seen = max([rows[n][1] for n in some] + ([seen] if seen else []))
    assert {r.n for r in split.late().collect()} == late == {9}
    assert sorted(r.n for r in split.on_time().collect()) == sorted(set(range(11)) - late)


def test_failure_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False), (3, False)], "id int, ok boolean")
    ledger = FailureLedger(spark, str(tmp_path / "f"), rows.schema)
    ledger.append(rows, 0)
    ledger.append(rows, 0)
    ledger.append(rows.where("id = 2"), 1)
    assert {r.id: r.failures for r in ledger.counts(["id"]).collect()} == {2: 2, 3: 1}


def test_stream_bursts_with_sequences_equal_batch(spark, tmp_path):
    rng = random.Random(12)
    t, rows = 0, []
    for i in range(500):
        t += rng.choice([20, 60, 300, 600, 601, 1000, 1001, 4000])
        rows.append((i, "s", START + timedelta(milliseconds=t), t, rng.random() < 0.8, rng.choice("AB"), rng.choice([None, 0, 1, 2, 3, 4, 5])))
    df = spark.createDataFrame(rows, "image_id long, session_id string, ts timestamp, time_ms long, has_subsec boolean, camera string, seq int")
    batch = group_bursts(df, ["session_id"], ["time_ms", "image_id"]).where("burst_id is not null")
    want = {(r.camera, r.first, r.n) for r in batch.groupBy("camera", "burst_id").agg(F.min(F.unix_micros("ts")).alias("first"), F.count("*").alias("n")).collect()}
    ends = [(10**6 + k, "s", START + timedelta(hours=1 + k), 0, True, "end", None) for k in (0, 1)]
    stream = _stream(spark, df.unionByName(spark.createDataFrame(ends, df.schema)), str(tmp_path), 6)
    _run(L.stream_bursts(stream), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.camera, r.first_us, r.burst_size) for r in got} == want and len(got) == len(want) > 20


def test_requests_coalesce_alike_in_a_stream_and_a_batch(spark, tmp_path):
    """Runs longer than the horizon in all stay one; a pause longer than it makes two."""
    rng = random.Random(3)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([1, 5, 20, 59, 60, 61, 90])
        rows.append((i, START + timedelta(seconds=t), i % 2 if t % 7 else 5))
    df = spark.createDataFrame(rows, "n int, ts timestamp, image int")
    end = spark.createDataFrame([(999, START + timedelta(days=9), -1), (1000, START + timedelta(days=10), -1)], df.schema)
    _run(L.dedupe_requests(_stream(spark, df.unionByName(end), str(tmp_path), 3), ["image"]), str(tmp_path))
    got = {(r.n, r.image) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.image >= 0}
    last, want = {}, set()
    for n, ts, image in rows:
        if image not in last or ts - last[image] > timedelta(minutes=1):
            want.add((n, image))
        last[image] = ts
    assert got == want == {(r.n, r.image) for r in L.dedupe_requests(df, ["image"]).collect()} and len(want) > 60


def test_state_table_keeps_its_files_few(spark, tmp_path):
    """Twenty batches of one path each: a read opens one version of a bucket, and vacuum leaves no other."""
    log = edits(spark, *[(i, f"p{i}", "mark", "Picked") for i in range(3)])
    table = StateTable(spark, str(tmp_path / "state"), log.schema, buckets=2)
    files = set()
    for i in range(20):
        table.upsert(edits(spark, (100 + i, f"p{i % 3}", "mark", "Rejected")), i)
        files.add(len(table._newest(None).inputFiles()))
    assert max(files) <= 2 * 4
    before = sorted(map(str, table.read().collect()))
    assert table.vacuum() > 0 and table.vacuum() == 0
    assert sorted(map(str, table.read().collect())) == before and len(before) == 3
    (tmp_path / "state" / "state" / "v=99").mkdir()
    assert table.read().count() == 3
    with pytest.raises(ValueError, match="buckets=2"):
        StateTable(spark, str(tmp_path / "state"), log.schema, buckets=4)
