from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievelight.functions.capture import capture_context
from sievelight.operators import cache as K
from sievelight.operators import copyplan as P
from sievelight.operators import metadata as M
from sievelight.operators import previews as V
from sievelight.operators import selection as S
from sievelight.operators import views as W

# -- views ----------------------------------------------------------------------

# One session: name order is 30, 10, 50, 20, 40; two frames have no time.
VIEW = [(10, "Rejected", "m2.nef", "2019:03:01 08:15:00.250"), (20, "Unmarked", "q7.nef", None), (30, "Picked", "k9.nef", "2019:03:01 08:15:00.750"),
        (40, "Picked", "z1.nef", None), (50, "Unmarked", "n4.nef", "2019:02:28 23:59:59.000")]


@pytest.fixture
def frames(spark):
    return spark.createDataFrame(VIEW, "path int, pick string, file_name string, sort_key string").withColumn("session_id", F.lit("s"))


def ids(df):
    return [r.path for r in df.collect()]


def test_view_orders(frames):
    by_time, by_name = [50, 10, 30, 20, 40], [30, 10, 50, 20, 40]
    assert ids(W.view(frames)) == by_time
    assert ids(W.view(frames, ascending=False)) == by_time[::-1]
    assert ids(W.view(frames, key=None)) == by_name
    assert ids(W.view(frames, key=None, ascending=False)) == by_name[::-1]
    assert ids(W.view(frames, "Picked")) == [30, 40]
    assert W.pick_counts(frames).first().asDict() == {"all": 5, "picked": 2, "rejected": 1, "unmarked": 2}


def test_provisional_until_complete(frames):
    for status, want in (("Loaded", [50, 10, 30, 20, 40]), ("Failed", [50, 10, 30, 20, 40]), ("Placeholder", [30, 10, 50, 20, 40])):
        rows = frames.withColumn("status", F.when(F.col("path") == 20, status).otherwise("Loaded"))
        assert ids(W.provisional_positions(rows, ["session_id"]).orderBy("position")) == want


@pytest.mark.parametrize("slice_rows", [None, 5])
def test_nearest_survivor_against_loop(spark, sliced, slice_rows):
    rng = random.Random(2)
    views = {s: [rng.random() < 0.3 for _ in range(rng.randrange(1, 30))] for s in range(40)}
    want = {}
    for s, keep in views.items():
        for i in range(len(keep)):
            near = sorted((abs(i - j), j) for j in range(len(keep)) if keep[j])
            want[s, i] = near[0][1] if near else None
    if slice_rows:
        sliced(slice_rows)
    df = spark.createDataFrame([(s, i, k) for s, ks in views.items() for i, k in enumerate(ks)], "s int, i int, keep boolean")
    got = W.nearest_survivor(df, ["s"], ["i"], F.col("keep"), "i").collect()
    assert {(r.s, r.i): r.survivor for r in got} == want


# -- selections and marks ----------------------------------------------------------

def test_selection(spark, frames):
    view = W.view_positions(frames, ["session_id"])
    pick = lambda *p: spark.createDataFrame([("s", i) for i in p], "session_id string, path int")
    span = lambda a, t, base: sorted(r.path for r in S.extend_range(
        view, spark.createDataFrame([("s", a, t)], "session_id string, anchor int, target int"), base, ["session_id"], "path").collect())
    # View order is 50, 10, 30, 20, 40.
    assert span(10, 20, pick()) == [10, 20, 30] and span(20, 10, pick(50)) == [10, 20, 30, 50] and span(10, 77, pick(20)) == [20]
    assert sorted(r.path for r in S.toggle(pick(1, 2), pick(2, 3), ["session_id", "path"]).collect()) == [1, 3]
    batch = lambda sel, cur: sorted(r.path for r in S.batch_rows(view, sel, ["session_id"], "path", cur).collect())
    assert batch(pick(10, 99), pick(30)) == [10] and batch(pick(), pick(30)) == [30] and batch(pick(), pick(99)) == []
    assert S.count_in_view(view, pick(10, 20, 99), ["session_id", "path"]).first().selected == 2
    assert S.count_in_view(view, pick(), ["session_id", "path"]).first().selected == 0


def test_marks(spark, frames):
    names = ["m2.nef", "up/m2.nef", "d\\m2.nef", "E:m2", "..", "other.nef"]
    marks = spark.createDataFrame([("s", n) for n in names], "session_id string, file_name string")
    got = {r.file_name: r.reason for r in S.validate_marks(marks, frames, ["session_id"]).collect()}
    assert got["m2.nef"] is None and got["other.nef"] == "not among the session's files"
    assert len([r for r in got.values() if r == "the mark names a folder"]) == 4
    ordered = spark.createDataFrame([(10, "Picked", 1), (10, "Unmarked", 3), (10, "Rejected", 2), (30, "Rejected", 1)], "path int, mark string, n int")
    got = {r.path: r.pick for r in S.apply_marks(frames, ordered, ["path"], "n").collect()}
    assert (got[10], got[30], got[40]) == ("Unmarked", "Rejected", "Picked")


def test_edit_beats_stored_even_with_null(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    edits = spark.createDataFrame([(1, None, True), (2, "x", False)], "k int, v string, v_edited boolean")
    assert {r.k: r.v for r in S.merge_precedence(stored, edits, ["k"], ["v"]).collect()} == {1: None, 2: "b", 3: "c"}


# -- metadata -----------------------------------------------------------------------

def test_add_keywords(spark):
    df = spark.createDataFrame([(["Birds", "birds"], ["BIRDS", "Straße", "STRASSE", " é ", "é", "\u0007", "x\u001fy"]), ([], [])],
                               "a array<string>, b array<string>")
    got = [r[0] for r in df.select(M.add_keywords(F.col("a"), F.col("b"))).collect()]
    assert got == [["Birds", "birds", "Straße", "é", "xy"], []]


def test_template_batch(spark):
    df = spark.createDataFrame([(7, "Lyon", None, "kept", "x", ["Sea", "sky"]), (8, None, "gone", None, None, []), (9, None, None, None, None, ["SEA"])],
                               "id int, city string, headline string, title string, creator string, keywords array<string>")
    ctx = capture_context(F.lit("2018:11:03 06:00:59"), F.lit(None).cast("timestamp"), F.format_string("P%03d.nef", "id"), F.lit("B2"))
    df = df.withColumns({"s": F.lit(1), "context": ctx})
    out = M.apply_template(df, {"headline": "{seq} of {date}", "city": "Bergen", "creator": " "}, ["sea", "{filename}"], ["s"], ["id"])
    rows = out.orderBy("id").collect()
    assert [r.headline for r in rows] == ["1 of 2018-11-03", "2 of 2018-11-03", "3 of 2018-11-03"]
    assert [(r.city, r.creator, r.title) for r in rows] == [("Bergen", None, "kept"), ("Bergen", None, None), ("Bergen", None, None)]
    assert [r.keywords for r in rows] == [["Sea", "sky", "P007"], ["sea", "P008"], ["SEA", "P009"]]
    back = M.revert_batch(out, df, ["id"], ["title", "creator", "headline", "city", "keywords"])
    assert M.changed_rows(df, back, ["id"], ["title", "creator", "headline", "city", "keywords"]).count() == 0
    with pytest.raises(ValueError):
        M.apply_template(df, {"city": "ok", "title": "{what}"}, [], ["s"], ["id"])


def test_edits_that_change_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, city string")
    batch = df.where("id = 1").select("id")
    same = M.edit_fields(df, batch, ["id"], "city", "a")
    assert M.changed_rows(df, same, ["id"], ["city"]).count() == 0
    assert M.edit_fields(df, batch, ["id"], "city", " \u0000 ") is df
    assert [r.id for r in M.changed_rows(df, M.edit_fields(df, batch, ["id"], "city", None), ["id"], ["city"]).collect()] == [1]


def test_summary_and_coverage(spark):
    df = spark.createDataFrame([(1, "a", None, "x", ["k", "j", "k"]), (2, "a", None, None, ["j"])],
                               "id int, same string, unset string, some string, kw array<string>")
    got = {r.field: (r.value, r.mixed) for r in M.field_summary(df, ["same", "unset", "some"]).collect()}
    assert got == {"same": ("a", False), "unset": (None, False), "some": (None, True)}
    rows = M.keyword_coverage(df, F.col("kw"), "id", "id").orderBy("first_row", "first_at").collect()
    assert [(r.keyword, r.n, r.total) for r in rows] == [("k", 2, 2), ("j", 2, 2)]


# -- copy plan ------------------------------------------------------------------------

def sources(spark, names, **over):
    rows = [(i, "s", "/out", n, over.get("size", 1), over.get("sidecar")) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "image_id int, session_id string, dest string, file_name string, size long, src_sidecar_mtime timestamp")
    ctx = capture_context(F.lit("2026:07:26 01:02:03"), F.lit(None).cast("timestamp"), F.col("file_name"), F.lit(None).cast("string"))
    return df.withColumn("context", ctx)


def listing(spark, names):
    return spark.createDataFrame([("/out", n, 1, None) for n in names], "dest string, name string, size long, sidecar_mtime timestamp")


def planned(spark, names, there, **kw):
    plan = P.plan_copy(sources(spark, names), listing(spark, there), order=["image_id"], **kw)
    return [(r.name, r.action) for r in plan.orderBy("image_id").collect()]


def test_plan_modes(spark):
    assert planned(spark, ["b.ARW", "a.ARW"], [], template="{date}_{seq}.{ext}") == [("2026-07-26_1.ARW", "Copy"), ("2026-07-26_2.ARW", "Copy")]
    assert planned(spark, ["a.ARW"], ["a.ARW"]) == [("a_2.ARW", "CopyRenamed")]
    assert planned(spark, ["a.ARW"], ["a.ARW"], mode="Skip") == [("a.ARW", "Skip")]
    assert planned(spark, ["a.ARW"], ["a.ARW"], mode="Overwrite") == [("a.ARW", "Copy")]
    # A name that another source takes by itself is never handed out.
    assert planned(spark, ["a.ARW", "a_2.ARW"], ["a.ARW"]) == [("a_3.ARW", "CopyRenamed"), ("a_2.ARW", "Copy")]
    ledger = spark.createDataFrame([(0, "/out")], "image_id int, dest string")
    assert planned(spark, ["a.ARW", "b.ARW"], ["a.ARW"], ledger=ledger) == [("a.ARW", "Skip"), ("b.ARW", "Copy")]


def test_plan_guards(spark):
    order = dict(order=["image_id"])
    plan = P.plan_copy(sources(spark, ["b.ARW", "a.ARW", "c.ARW"]), listing(spark, []), template="same.{ext}", **order)
    with pytest.raises(P.CopyPlanError, match="b.ARW and a.ARW would both become same.ARW"):
        P.guard_plan(plan, **order)
    plan = P.plan_copy(sources(spark, ["a.ARW", "b.ARW"]), listing(spark, ["a.ARW"]), mode="Abort", **order)
    with pytest.raises(P.CopyPlanError, match="1 target names"):
        P.guard_plan(plan, mode="Abort", **order)
    plan = P.plan_copy(sources(spark, ["a.ARW", "b.ARW"], size=10), listing(spark, []), **order)
    with pytest.raises(P.CopyPlanError, match="20 bytes and 19"):
        P.guard_plan(plan, free_bytes=19, **order)
    with pytest.raises(P.CopyPlanError, match="below"):
        P.guard_plan(plan, folders=("/card", "/card/selects"), **order)
    assert P.guard_plan(plan, free_bytes=20, folders=("/card", "/out"), **order) is plan


def test_sidecar_refresh_and_failed_sources(spark):
    from datetime import datetime
    rows = sources(spark, ["a.ARW"], sidecar=datetime(2026, 1, 2))
    older = spark.createDataFrame([("/out", "a.ARW", 1, datetime(2026, 1, 1))], "dest string, name string, size long, sidecar_mtime timestamp")
    newer = older.withColumn("sidecar_mtime", F.lit(datetime(2026, 1, 3)))
    act = lambda there: P.plan_copy(rows, there, mode="Skip", order=["image_id"]).first().action
    assert (act(older), act(newer)) == ("SidecarRefresh", "Skip")
    marked = sources(spark, ["a.ARW", "b.ARW"]).withColumn("status", F.when(F.col("image_id") == 0, "Failed").otherwise("Loaded"))
    count = lambda **kw: P.plan_copy(marked, listing(spark, []), order=["image_id"], **kw).count()
    assert (count(), count(include_failed=True)) == (1, 2)


@pytest.mark.parametrize("slice_rows", [None, 4])
def test_suffix_against_loop(spark, sliced, slice_rows):
    rng = random.Random(4)
    bases = ["a.ARW", "a", ".rc", "b.c.jpg", "x_2.ARW", "n_."]
    rows, taken, want = [], [], {}
    for d in range(120):
        names = set()
        for b in bases:
            for k in rng.sample(range(1, 7), rng.randrange(6)):
                stem, dot, ext = b.rpartition(".")
                names.add(f"{stem}_{k}.{ext}" if dot and stem else f"{b}_{k}")
                if rng.random() < 0.2:
                    names.add(f"{stem}_0{k}.{ext}" if dot and stem else f"{b}_0{k}")
        taken += [(d, n) for n in names]
        for b in bases:
            stem, dot, ext = b.rpartition(".")
            form = (lambda k: f"{stem}_{k}.{ext}") if dot and stem else (lambda k: f"{b}_{k}")
            want[d, b] = next(form(k) for k in range(2, 99) if form(k) not in names)
            rows.append((d, b))
    if slice_rows:
        sliced(slice_rows)
    got = P.assign_free_suffix(spark.createDataFrame(rows, "dest int, name string"), spark.createDataFrame(taken, "dest int, name string"), ["dest"])
    assert {(r.dest, r.name): r.free_name for r in got.collect()} == want


def test_report(spark):
    rows = [(1, "Copy", True), (2, "CopyRenamed", True), (3, "Skip", True), (4, "SidecarRefresh", True)]
    good = spark.createDataFrame(rows, "image_id int, action string, ok boolean")
    r = P.copy_report(good).first()
    assert (r.copied, r.skipped, r.refreshed, r.failed, r.verified) == (2, 1, 1, 0, True)
    assert not P.copy_report(good, cancelled=True).first().verified
    assert not P.copy_report(good.where("action = 'Skip'")).first().verified
    assert [x.image_id for x in P.copied_rows(good).orderBy("image_id").collect()] == [1, 2]
    bad = good.withColumn("ok", F.col("image_id") != 2)
    assert (P.copy_report(bad).first().verified, P.failures(bad).first().image_id) == (False, 2)


# -- cache and previews ------------------------------------------------------------------

def test_cache_round(spark):
    frames = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 1, None)], "path string, size long, mtime_ns long")
    empty = spark.createDataFrame([], "path string, size long, mtime_ns long, capture string, payload_bytes long, last_used long, schema_version int")
    hits, misses = K.cache_split(frames, empty)
    assert (hits.count(), misses.count()) == (0, 3)
    fresh = misses.select("*", F.when(F.col("path") == "a", "{}").alias("capture"), F.lit(5).cast("long").alias("payload_bytes"))
    cache = K.upsert_cache(empty, fresh, hits, now=100)
    assert sorted(r.path for r in cache.collect()) == ["a", "b"]  # no mtime, never stored
    hits, misses = K.cache_split(frames, cache)
    assert sorted(r.path for r in hits.collect()) == ["a", "b"] and [r.path for r in misses.collect()] == ["c"]
    changed = frames.withColumn("mtime_ns", F.col("mtime_ns") + 1)
    assert K.cache_split(changed, cache)[0].count() == 0
    assert K.cache_split(frames, cache.withColumn("schema_version", F.lit(2)))[0].count() == 0
    later = K.upsert_cache(cache, fresh.limit(0), hits.where("path = 'a'"), now=200)
    assert {r.path: r.last_used for r in later.collect()} == {"a": 200, "b": 100}
    assert K.stored_bytes(cache).first().asDict() == {"bytes": 10, "rows": 2}
    assert K.stored_bytes(empty).first().asDict() == {"bytes": 0, "rows": 0}


@pytest.mark.parametrize("slice_rows", [None, 30])
@pytest.mark.parametrize("cap", [0, 100, 5000, 10**9])
def test_eviction_against_loop(spark, sliced, cap, slice_rows):
    rng = random.Random(cap)
    rows = [(f"p{i:03}", rng.randrange(50), rng.randrange(40)) for i in range(300)]
    left = sorted(rows, key=lambda r: (r[2], r[0]))
    while left and sum(r[1] for r in left) > cap:
        left = left[64:]
    pinned = "p007"
    kept = sorted(rows, key=lambda r: (r[2], r[0]))
    while sum(r[1] for r in kept) > cap and len(kept) > 1:
        kept.remove(next(r for r in kept if r[0] != pinned))
    if slice_rows:
        sliced(slice_rows)
    df = spark.createDataFrame(rows, "path string, payload_bytes long, last_used long")
    assert {r.path for r in K.lru_evict(df, cap).where("not evict").collect()} == {r[0] for r in left}
    got = K.lru_evict(df, cap, pinned=F.col("path") == pinned).where("not evict").collect()
    assert {r.path for r in got} == {r[0] for r in kept}


def previews(spark, *rows):
    return spark.createDataFrame([("f", i * 10, n, w, h, whole) for i, (n, w, h, whole) in enumerate(rows)],
                                 "path string, offset long, len long, width int, height int, whole_file boolean")


def test_pick_preview(spark):
    pick = lambda rows, *a, **k: next(iter(V.pick_preview(previews(spark, *rows), *a, **k).collect()), None)
    small, mid, big = (5, 160, 120, False), (50, 1616, 1080, False), (500, 8640, 5760, False)
    assert pick([small, mid, big]).width == 1616
    assert pick([small, big]).width == 8640
    assert pick([small]) is None and pick([(5, 160, 120, True)]).width == 160
    assert pick([small, mid, big], "full").width == 8640
    r = pick([mid, big], target_long=2020)
    assert (r.width, r.terminal) == (1616, False)
    r = pick([mid, big], target_long=2021)
    assert (r.width, r.terminal) == (8640, True)
    assert pick([mid], target_long=9000).terminal
    assert pick([(40, 1000, 1000, False), (60, 1000, 1000, False)]).len == 40  # same pixels: the shorter payload


def test_output_names(spark):
    df = spark.createDataFrame([(0, "a.ARW"), (1, "b.ARW"), (2, "a.arw")], "i int, name string")
    got = V.dedupe_output_names(df, "name", "i").orderBy("i").collect()
    assert [r.output for r in got] == ["a.jpg", "b.jpg", "a_2.jpg"]
