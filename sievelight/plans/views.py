"""Views, positions, selections and marks, checked on ``events``, ``orders`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions.capture import needs_refresh
from sievelight.operators import selection as S
from sievelight.operators import views as V
from sievelight.operators.metadata import changed_rows
from sievelight.plans.registry import EVENT_FRAMES, event_frames, query, table


@query("filter_pick", f"WITH {EVENT_FRAMES} SELECT image_id, file_name, pick FROM frames WHERE pick = 'Picked'")
def filter_pick(spark, sf):
    return V.filter_pick(event_frames(spark, sf), "Picked").select("image_id", "file_name", "pick")


def _keyed(spark, sf):
    # Error events stand for files without a capture time.
    key = F.when(F.col("event_type") != "error", F.col("capture_time"))
    return event_frames(spark, sf).withColumn("sort_key", key)


_VIEW = """WITH {frames}, keyed AS (SELECT *, CASE WHEN event_type <> 'error' THEN capture_time END AS sort_key FROM frames)
SELECT session_id, image_id, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS position FROM keyed"""


@query("view", _VIEW.format(frames=EVENT_FRAMES, order="sort_key ASC NULLS LAST, file_name, image_id"))
def view_ascending(spark, sf):
    return V.view_positions(_keyed(spark, sf), ["session_id"], tie="image_id").select("session_id", "image_id", "position")


@query("view_descending", _VIEW.format(
    frames=EVENT_FRAMES, order="sort_key DESC NULLS FIRST, file_name DESC, image_id DESC"))
def view_descending(spark, sf):
    rows = V.view_positions(_keyed(spark, sf), ["session_id"], tie="image_id", ascending=False)
    return rows.select("session_id", "image_id", "position")


@query("view_sorted", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def view_sorted(spark, sf):
    rows = table(spark, sf, "customer").withColumn(
        "pick", F.when(F.col("c_acctbal") > 0, "Picked").otherwise("Unmarked"))
    rows = V.view(rows, "Picked", "c_acctbal", "c_name", "c_custkey", ascending=False)
    return rows.select("c_custkey", "c_name", "c_acctbal")


@query("load_progress", """
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') AS loaded, count(*) AS total,
       bool_and(o_orderstatus <> 'P') AS complete FROM orders GROUP BY o_custkey""")
def load_progress(spark, sf):
    rows = table(spark, sf, "orders").withColumn(
        "status", F.when(F.col("o_orderstatus") == "P", "Placeholder").otherwise("Loaded"))
    return V.load_progress(rows, ["o_custkey"])


@query("provisional_order", """
WITH o AS (SELECT *, bool_and(o_orderstatus <> 'P') OVER (PARTITION BY o_custkey) AS complete FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN complete THEN o_totalprice END NULLS LAST, o_orderpriority, o_orderkey) AS position FROM o""")
def provisional_order(spark, sf):
    rows = table(spark, sf, "orders").withColumn(
        "status", F.when(F.col("o_orderstatus") == "P", "Placeholder").otherwise("Loaded"))
    out = V.provisional_positions(rows, ["o_custkey"], "o_totalprice", "o_orderpriority", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "position")


@query("number_batch", """
SELECT o_custkey, o_orderkey, row_number() OVER w AS seq, count(*) OVER (PARTITION BY o_custkey) AS batch_len
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def number_batch(spark, sf):
    rows = V.number_batch(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", "o_orderkey", "seq", "batch_len")


@query("nearest_survivor", f"""
WITH {EVENT_FRAMES}, v AS (SELECT *, event_type = 'purchase' AS keep,
    row_number() OVER (PARTITION BY session_id ORDER BY time_us, image_id) AS pos FROM frames),
n AS (SELECT session_id, image_id, keep, pos,
    max(CASE WHEN keep THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
    min(CASE WHEN keep THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM v),
t AS (SELECT *, CASE WHEN ahead IS NULL OR pos - back <= ahead - pos THEN back ELSE ahead END AS target FROM n)
SELECT t.session_id, t.image_id, t.pos AS position, v.image_id AS survivor
FROM t LEFT JOIN v ON v.session_id = t.session_id AND v.pos = t.target""")
def nearest_survivor(spark, sf):
    rows = V.nearest_survivor(event_frames(spark, sf), ["session_id"], ["time_us", "image_id"],
                              F.col("event_type") == "purchase", "image_id")
    return rows.select("session_id", "image_id", "position", "survivor")


@query("pick_counts", f"""
WITH {EVENT_FRAMES} SELECT session_id, count(*) AS "all", count(*) FILTER (WHERE pick = 'Picked') AS picked,
 count(*) FILTER (WHERE pick = 'Rejected') AS rejected, count(*) FILTER (WHERE pick = 'Unmarked') AS unmarked
FROM frames GROUP BY session_id""")
def pick_counts(spark, sf):
    return V.pick_counts(event_frames(spark, sf), ["session_id"])


# -- selections ---------------------------------------------------------------

def _rich(spark, sf):
    """Customers with a positive balance, as a selection of (nation, customer)."""
    return table(spark, sf, "customer").where("c_acctbal > 5000").select("c_nationkey", "c_custkey")


def _building(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_nationkey", "c_custkey")


@query("select_all", "SELECT c_nationkey, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_all(spark, sf):
    return S.select_all(_building(spark, sf), ["c_nationkey", "c_custkey"])


@query("toggle", """
SELECT c_nationkey, c_custkey FROM customer WHERE (c_acctbal > 5000) <> (c_mktsegment = 'BUILDING')""")
def toggle(spark, sf):
    return S.toggle(_rich(spark, sf), _building(spark, sf), ["c_nationkey", "c_custkey"])


@query("extend_range", f"""
WITH {EVENT_FRAMES}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_us, image_id) AS pos FROM frames),
ends AS (SELECT session_id, arg_max(pos, value * 1000000 + image_id / 1000000.0) AS a, arg_min(pos, value * 1000000 + image_id / 1000000.0) AS b FROM v GROUP BY session_id)
SELECT v.session_id, v.image_id FROM v JOIN ends e ON v.session_id = e.session_id AND v.pos BETWEEN least(a, b) AND greatest(a, b)
UNION SELECT session_id, image_id FROM frames WHERE event_type = 'signup'""")
def extend_range(spark, sf):
    frames = event_frames(spark, sf)
    # From the day's largest value to its smallest, united with all sign-ups.
    rank = F.col("value") * 1000000 + F.col("image_id") / 1000000.0
    anchors = frames.groupBy("session_id").agg(
        F.max_by("image_id", rank).alias("anchor"), F.min_by("image_id", rank).alias("target"))
    view = V.view_positions(frames, ["session_id"], "time_us", "file_name", "image_id")
    base = frames.where("event_type = 'signup'")
    return S.extend_range(view, anchors, base, ["session_id"], "image_id")


@query("batch_rows", """
WITH sel AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_acctbal > 9900),
fb AS (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, c_custkey FROM sel
UNION ALL SELECT c_nationkey, c_custkey FROM fb WHERE c_nationkey NOT IN (SELECT c_nationkey FROM sel)""")
def batch_rows(spark, sf):
    view = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    chosen = view.where("c_acctbal > 9900")
    fallback = view.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    return S.batch_rows(view, chosen, ["c_nationkey"], "c_custkey", fallback).select("c_nationkey", "c_custkey")


@query("count_in_view", """
SELECT o_orderpriority, count(*) AS selected FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY o_orderpriority""")
def count_in_view(spark, sf):
    selected = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.count_in_view(table(spark, sf, "orders"), selected, ["o_orderkey"], ["o_orderpriority"])


# -- marks --------------------------------------------------------------------

@query("validate_marks", r"""
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '../' ELSE '' END || 'Customer#' ||
  lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS file_name FROM orders)
SELECT o_orderkey, file_name, CASE WHEN file_name LIKE '%/%' THEN 'the mark names a folder'
  WHEN file_name NOT IN (SELECT c_name FROM customer) THEN 'not among the session''s files' END AS reason FROM m""")
def validate_marks(spark, sf):
    marks = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("s").alias("session_id"),
        F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "../").otherwise(""),
                 F.format_string("Customer#%09d", F.col("o_custkey") * 2)).alias("file_name"))
    frames = table(spark, sf, "customer").select(F.lit("s").alias("session_id"), F.col("c_name").alias("file_name"))
    return S.validate_marks(marks, frames, ["session_id"]).select("o_orderkey", "file_name", "reason")


@query("apply_marks", """
WITH m AS (SELECT user_id, arg_max(event_type, event_id) AS mark FROM events GROUP BY user_id)
SELECT c_custkey, coalesce(mark, 'Unmarked') AS pick FROM customer LEFT JOIN m ON user_id = c_custkey""")
def apply_marks(spark, sf):
    frames = table(spark, sf, "customer").select("c_custkey", F.lit("Unmarked").alias("pick"))
    marks = table(spark, sf, "events").select(
        F.col("user_id").alias("c_custkey"), F.col("event_type").alias("mark"), "event_id")
    return S.apply_marks(frames, marks, ["c_custkey"], "event_id").select("c_custkey", "pick")


@query("merge_precedence", """
WITH e AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, event_id)
    FILTER (WHERE event_type <> 'view') AS x, max(event_id) FILTER (WHERE event_type <> 'view') AS pid,
    arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS kind, max(value) AS v FROM events GROUP BY user_id)
SELECT o_orderkey, CASE WHEN pid IS NOT NULL THEN CASE WHEN kind = 'error' THEN NULL ELSE kind END ELSE o_orderstatus END AS pick,
 CASE WHEN v > 100 THEN v ELSE o_totalprice END AS price
FROM orders LEFT JOIN e ON user_id = o_custkey""")
def merge_precedence(spark, sf):
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    mark = F.col("event_type") != "view"
    edits = table(spark, sf, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(
        F.max_by(F.struct(kind.alias("v")), F.when(mark, F.col("event_id")))["v"].alias("pick"),
        F.bool_or(mark).alias("pick_edited"),
        F.max("value").alias("price"), (F.max("value") > 100).alias("price_edited"))
    stored = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("pick"), F.col("o_totalprice").alias("price"))
    return S.merge_precedence(stored, edits, ["o_custkey"], ["pick", "price"]).select("o_orderkey", "pick", "price")


@query("attach_sidecars", """
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'Picked' ELSE 'Unmarked' END AS pick, CAST(coalesce(toxic, 0) AS BIGINT) AS n_keywords
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def attach_sidecars(spark, sf):
    frames = table(spark, sf, "documents").select("doc_id")
    words = F.array_repeat(F.lit("toxic"), F.col("toxic"))
    sidecars = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "Picked").alias("pick"), words.alias("keywords"))
    out = S.attach_sidecars(frames, sidecars, ["doc_id"])
    return out.select("doc_id", "pick", F.size("keywords").cast("bigint").alias("n_keywords"))


@query("changed_rows", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, upper(c_name) AS c_name
FROM customer WHERE c_acctbal < 0 OR upper(c_name) <> c_name""")
def changed_rows_query(spark, sf):
    before = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    after = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.upper("c_name").alias("c_name"))
    return changed_rows(before, after, ["c_custkey"], ["c_mktsegment", "c_name"])


@query("needs_refresh", """
WITH l AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus <> 'F' AND (shipped IS NULL OR o_orderdate > shipped) AS refresh
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def needs_refresh_query(spark, sf):
    copied = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("shipped"))
    source = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    return table(spark, sf, "orders").join(copied, "o_orderkey", "left").select(
        "o_orderkey", needs_refresh(source, F.col("shipped")).alias("refresh"))
