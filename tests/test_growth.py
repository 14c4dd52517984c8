"""What has to grow with the input only: files flushed together, folders listed by tasks, bounded batches."""

from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone

import oracle
import pandas as pd
from pyspark.sql import functions as F

from sievelight.operators.cache import read_cache, save_cache
from sievelight.operators.copyplan import assign_free_suffix
from sievelight.plans import QUERIES
from sievelight.plans.registry import table
from sievelight.session import BATCH_BYTES
from sievelight.sources import files as L
from sievelight.sources import places
from sievelight.sources.jobs import ship_package
from sievelight.streaming import edits as E
from sievelight.streaming import live as V
from sievelight.streaming import sidecars as W


def test_files_are_flushed_together_before_any_is_moved(tmp_path, monkeypatch):
    events = []
    monkeypatch.setattr(places.os, "fsync", lambda fd: events.append(("flush", len([n for n in os.listdir(tmp_path) if ".part-" not in n]))))
    monkeypatch.setattr(places, "GROUP_FILES", 3)

    def fail(f):
        f.write(b"half")
        raise ValueError("no more")

    jobs = [(f"{tmp_path}/{i}", fail if i == 2 else lambda f, i=i: f.write(b"%d" % i), None) for i in range(7)] + [("nowhere://h/x", lambda f: None, None)]
    got = list(places.write_each(iter(jobs)))
    assert [e is None for e in got] == [True, True, False, True, True, True, True, False]
    assert events == [("flush", 0)] * 2 + [("flush", 2)] * 3 + [("flush", 5)]
    assert sorted(os.listdir(tmp_path)) == ["0", "1", "3", "4", "5", "6"] and (tmp_path / "6").read_bytes() == b"6"


def test_writes_that_end_early_leave_no_parts(tmp_path):
    some = places.write_each((f"{tmp_path}/{i}", lambda f: f.write(b"x"), None) for i in range(places.GROUP_FILES + 5))
    next(some)
    some.close()
    assert not [n for n in os.listdir(tmp_path) if places.is_part(n)]


def test_read_files_hands_on_many_at_once(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"{i}").write_bytes(b"x" * i)
    read = L.read_files(spark.createDataFrame([(f"{tmp_path}/{i}",) for i in range(50)], "path string"), tasks=1)
    sizes = read.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n long").collect()
    assert sum(r.n for r in read.select(F.octet_length("content").alias("n")).collect()) == sum(range(50))
    assert [r.n for r in sizes] == [50]


def _watch(spark, home, run, **options):
    stream = V.watch_folder(spark, str(home / "in"), **options).writeStream.format("parquet").option("path", str(home / "out"))
    stream.option("checkpointLocation", str(home / "progress")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.file_name, r.size) for r in spark.read.parquet(str(home / "out")).collect())


def test_watched_folder_tells_each_file_once(spark, tmp_path):
    """Over restarts, with empty files, moved ones of an old time, rewritten ones and temporary names."""
    inside = tmp_path / "in"
    inside.mkdir()
    (inside / "a.ARW").write_bytes(b"a")
    (inside / "empty.ARW").write_bytes(b"")
    (inside / f"late.ARW.part-{'0' * 32}").write_bytes(b"half")
    assert _watch(spark, tmp_path, 0) == [("a.ARW", 1), ("empty.ARW", 0)]
    (tmp_path / "old").write_bytes(b"old")
    os.utime(tmp_path / "old", (1, 1))
    os.rename(tmp_path / "old", inside / "old.ARW")
    (inside / "a.ARW").write_bytes(b"again")
    (inside / "_DSC1.ARW").write_bytes(b"12")
    assert _watch(spark, tmp_path, 1) == [("_DSC1.ARW", 2), ("a.ARW", 1), ("empty.ARW", 0), ("old.ARW", 3)]


def test_watched_folder_takes_globs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.ARW", "b.jpg", "c.JPG", "d{.ARW"):
        (tmp_path / "in" / n).write_bytes(b"x")
    assert [n for n, _ in _watch(spark, tmp_path, 0, glob="[ab]*.{ARW,jpg}")] == ["a.ARW", "b.jpg"]


def test_folder_stream_lists_on_tasks_and_rests(tmp_path):
    source = L.FolderStream([str(tmp_path)], 3)
    os.utime(tmp_path, (1, 1))
    first = source.latestOffset()
    assert source.latestOffset() == first and len(source.partitions(source.initialOffset(), first)) == 3
    (tmp_path / "x").write_bytes(b"x")
    later = source.latestOffset()
    assert later["before"] > first["before"]
    names = [r[1] for p in source.partitions(first, later) for r in source.read(p)]
    assert names == [f"{tmp_path}/x"]


def test_written_sidecars_are_read_back_by_tasks(spark):
    plan = QUERIES["write_sidecar_files"](spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "sievelight_folders" in plan


def test_queries_hand_python_some_megabytes_at_a_time(spark):
    """Ten thousand rows of text were one batch; the limit is on bytes, so a worker's memory does not follow the rows of a task."""
    rows = table(spark, "/root/testdata/sf0.1", "documents").select("text").coalesce(1)
    sizes = rows.mapInPandas(lambda bs: (pd.DataFrame({"n": [int(b["text"].str.len().sum())]}) for b in bs), "n long").collect()
    assert sum(r.n for r in sizes) > 20 << 20 and max(r.n for r in sizes) <= 5 << 20


def test_smallest_free_suffix_without_a_window(spark, sliced):
    """Against a loop, with gaps anywhere, names taken twice, and the largest number there is."""
    sliced(5)
    taken = {"a": [2, 2, 3, 5], "b": [3, 4], "c": list(range(2, 60)), "d": [2**63 - 1, 2], "e": [1, 0]}
    rows = [("/o", f"{n}_{k}.ARW") for n, ks in taken.items() for k in ks] + [("/p", "a_2.ARW"), ("/o", "a_02.ARW"), ("/o", "z_2.ARW"), ("/o", "f")]
    wanted = spark.createDataFrame([("/o", f"{n}.ARW") for n in "abcdef"], "dest string, name string")
    free = assign_free_suffix(wanted, spark.createDataFrame(rows, "dest string, name string"), ["dest"])
    assert {r.name[0]: r.free_name for r in free.collect()} == {
        n: f"{n}_{next(k for k in range(2, 99) if k not in taken.get(n, []))}.ARW" for n in "abcdef"}
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_slice" not in plan


def test_saved_cache_is_written_by_more_tasks_than_buckets(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("/c/"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("bigint").alias("size"),
                                   F.lit(5).cast("bigint").alias("mtime_ns"), F.lit(None).cast("string").alias("capture"), F.lit(0).cast("bigint").alias("payload_bytes"))
    root = str(tmp_path / "cache")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save_cache(spark, root, rows, rows.limit(0), now=1, buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    tasks = {n.split("-")[1] for d, _, names in os.walk(root) for n in names if n.startswith("part-")}
    assert len(tasks) > 2 and read_cache(spark, root).count() == 400


def test_stream_state_is_called_for_buckets_not_for_paths(spark, tmp_path):
    """Two hundred paths share four states; what comes out is that of the batch, null and odd paths apart."""
    at = lambda ms: datetime(2026, 7, 26, 10, tzinfo=timezone.utc) + timedelta(milliseconds=ms)
    rows = [(i, at(i % 7 * 300 + (i % 3) * 5000), f"p{i % 200}", "mark" if i % 2 else "keywords", "Picked" if i % 2 else None, None if i % 2 else [f"k{i}"], None) for i in range(1200)]
    schema = "seq long, ts timestamp, path string, kind string, pick string, keywords array<string>, fields struct<title:string>"
    log = spark.createDataFrame(rows, schema)
    ends = spark.createDataFrame([(5000 + k, at(10**8 * k), "end", "mark", "Picked", None, None) for k in (1, 2)], schema)
    for i, part in enumerate((log, ends.where("seq = 5001"), ends.where("seq = 5002"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/p={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("slot", E.slot())
    writes = E.spanned_writes(stream.withWatermark("ts", "10 seconds"), 700, 1000, buckets=4)
    run = writes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress")
    query = run.trigger(availableNow=True).start()
    query.awaitTermination()
    of = lambda df: sorted((r.path, r.slot, r.pick, r.keywords, r.edits, r.last_seq, r.write_at) for r in df.collect())
    got, want = of(spark.read.parquet(f"{tmp_path}/out").where("path <> 'end'")), of(E.coalesce_edits(log, 700, max_span_ms=1000))
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want] and got == want and len(got) > 400
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert states < 50


def test_waiting_rows_are_few_values_of_state():
    class Kept:
        def __init__(self):
            self.values, self.puts = [], 0

        def put(self, values):
            self.values, self.puts = values, self.puts + 1

        def clear(self):
            self.values = []

        def exists(self):
            return bool(self.values)

        def get(self):
            return iter(self.values)

    state = Kept()
    rows = [[i, None, True, "é\u0000" * (i % 3)] for i in range(25_000)]
    E.keep_rows(state, rows)
    assert len(state.values) == 3 and state.puts == 1 and E.kept_rows(state) == rows
    E.keep_rows(state, [])
    assert E.kept_rows(state) == []


def test_operators_bound_batches_unless_the_session_does(spark):
    before = spark.conf.get(BATCH_BYTES, None)
    try:
        spark.conf.unset(BATCH_BYTES)
        ship_package(spark)
        assert spark.conf.get(BATCH_BYTES) in ("4m", "4194304b")
        spark.conf.set(BATCH_BYTES, "8m")
        ship_package(spark)
        assert spark.conf.get(BATCH_BYTES) in ("8m", "8388608b")
    finally:
        spark.conf.set(BATCH_BYTES, before or "4m")


def _writes(spark, rows):
    """(image path, pick or None, keywords or None) as writes of ``coalesce_edits``."""
    columns = "path string, slot string, pick string, keywords array<string>, fields struct<title: string>, sets_fields boolean, last_seq long"
    marks = [(p, "pick", pick, None, None, False, 1) for p, pick, _ in rows if pick]
    words = [(p, "metadata", None, k, None, False, 2) for p, _, k in rows if k is not None]
    return spark.createDataFrame(marks + words, columns)


def test_edits_are_written_without_joins_to_the_texts(spark, tmp_path):
    """A join to the files' content is planned by the size of their paths, and so broadcasts it by way of the driver."""
    (tmp_path / "bad.xmp").write_bytes(b"<a>")
    (tmp_path / "latin.xmp").write_bytes(b"<a>\xff</a>")
    os.mkdir(tmp_path / "folder.xmp")
    names = [f"{tmp_path}/{n}" for n in ("new", "bad", "latin", "folder")]
    writes = _writes(spark, [(n, "Rejected", ["k"] if n.endswith("new") else None) for n in names])
    plan = W.edited_sidecars(writes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    done = {r.path.rpartition("/")[2]: (r.ok, (r.reason or "").split(":")[0]) for r in W.write_edits(writes).collect()}
    assert done == {"new.xmp": (True, ""), "bad.xmp": (False, "malformed XML"), "latin.xmp": (False, "bytes are not UTF-8 text"), "folder.xmp": (False, "not read")}
    assert (tmp_path / "bad.xmp").read_bytes() == b"<a>" and (tmp_path / "latin.xmp").read_bytes() == b"<a>\xff</a>"
    fresh = (tmp_path / "new.xmp").read_text()
    assert 'xmp:Rating="-1"' in fresh and fresh.count("<rdf:li>k</rdf:li>") == 2
    # The same image again: both of its edits, one after the other, in the file that is there now.
    again = W.write_edits(_writes(spark, [(names[0], "Picked", ["l"])])).collect()
    assert [r.ok for r in again] == [True]
    there = (tmp_path / "new.xmp").read_text()
    assert 'xmp:Rating="1"' in there and there.count("<rdf:li>l</rdf:li>") == 2 and "<rdf:li>k</rdf:li>" not in there


def test_read_files_keeps_columns(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}").write_bytes(b"x" * i)
    rows = spark.createDataFrame([(f"{tmp_path}/{i}", [f"k{i}"], (i,)) for i in range(4)], "path string, words array<string>, n struct<i: int>")
    got = L.read_files(rows, keep=["words", "n"]).orderBy("path").collect()
    assert [(r.words, r.n.i, r.content, r.error is None) for r in got] == [
        (["k0"], 0, b"", True), (["k1"], 1, b"x", True), (["k2"], 2, b"xx", True), (["k3"], 3, None, False)]
