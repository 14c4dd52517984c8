"""Copy planning and its reports: ``orders`` are the sources, ``lineitem`` and ``part`` the destination."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions.capture import capture_context
from sievelight.operators import copyplan as P
from sievelight.operators.previews import dedupe_output_names
from sievelight.plans.registry import query, table

_NAME = "'DSC' || lpad(CAST({} AS VARCHAR), 12, '0') || '.ARW'"


def _name(col):
    return F.concat(F.lit("DSC"), F.lpad(F.col(col).cast("string"), 12, "0"), F.lit(".ARW"))


def _sources(spark, sf):
    rows = table(spark, sf, "orders")
    name = _name("o_orderkey")
    return rows.select(
        F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("session_id"), F.lit("/out").alias("dest"),
        name.alias("file_name"), F.col("o_totalprice").cast("bigint").alias("size"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("src_sidecar_mtime"),
        F.col("o_orderdate"),
        capture_context(F.lit(None).cast("string"), F.col("o_orderdate"), name, F.lit(None).cast("string")).alias("context"))


def _listing(spark, sf):
    """What lies at the destination: orders with shipped lines, and suffixed names in between."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("shipped"), F.sum("l_quantity").alias("q"), F.max("l_linenumber").alias("last"))
    # k = 1 stands for the order's own name; a last line of 5 leaves the gap at suffix 3.
    names = lines.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.col("last") - 1, F.lit(1))))).where(
        "not (last = 5 and k = 3)")
    own = F.col("k") == 1
    stem = F.concat(F.lit("DSC"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    suffix = F.when(own, "").otherwise(F.concat(F.lit("_"), F.col("k").cast("string")))
    return names.select(
        F.lit("/out").alias("dest"), F.concat(stem, suffix, F.lit(".ARW")).alias("name"),
        F.when(own, F.col("q")).otherwise(1).cast("bigint").alias("size"),
        F.when(own & (F.col("q") > 50), F.col("shipped")).alias("sidecar_mtime"))


def _ledger(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("image_id"), F.lit("/out").alias("dest"))


_PLAN = f"""
  l AS (SELECT l_orderkey, max(l_shipdate) AS shipped, sum(l_quantity) AS q, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey),
  f AS (SELECT o_orderkey AS image_id, o_custkey AS session_id, CAST(trunc(o_totalprice) AS BIGINT) AS size, o_orderpriority,
          {_NAME.format('o_orderkey')} AS file_name, l_orderkey IS NOT NULL AS taken, o_orderpriority = '1-URGENT' AS done, last,
          CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS sm, CASE WHEN q > 50 THEN shipped END AS dm
        FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
  k AS (SELECT *, CASE WHEN last = 5 THEN 3 WHEN last > 2 THEN last ELSE 2 END AS free FROM f)"""
_ACTION = """CASE WHEN {skip} THEN CASE WHEN sm IS NOT NULL AND (dm IS NULL OR sm > dm) THEN 'SidecarRefresh' ELSE 'Skip' END
   WHEN taken AND {rename} THEN 'CopyRenamed' ELSE 'Copy' END"""
_RENAME = f"""WITH {_PLAN}, a AS (SELECT *, {_ACTION.format(skip='done', rename='TRUE')} AS action FROM k)"""


def _plan(spark, sf, **options):
    # Only a template needs the context, and the plan is written with all columns of its sources.
    return P.plan_copy(_sources(spark, sf).drop("context"), _listing(spark, sf), _ledger(spark, sf), order=["image_id"], **options)


@query("plan_copy", _RENAME + """
SELECT image_id, CASE WHEN action = 'CopyRenamed' THEN replace(file_name, '.ARW', '_' || CAST(free AS VARCHAR) || '.ARW') ELSE file_name END AS name,
  action, CASE WHEN action LIKE 'Copy%' THEN size ELSE 0 END AS bytes FROM a""")
def plan_copy(spark, sf):
    return _plan(spark, sf).select("image_id", "name", "action", "bytes")


@query("plan_copy_skip", f"""WITH {_PLAN}, a AS (SELECT *, {_ACTION.format(skip='done OR taken', rename='FALSE')} AS action FROM k)
SELECT image_id, file_name AS name, action, CASE WHEN action = 'Copy' THEN size ELSE 0 END AS bytes FROM a""")
def plan_copy_skip(spark, sf):
    return _plan(spark, sf, mode="Skip").select("image_id", "name", "action", "bytes")


@query("plan_copy_template", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey AS image_id, CAST(o_custkey AS VARCHAR) AS dest, strftime(o_orderdate, '%Y-%m-%d') || '_' || lpad(CAST(seq AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), '0') || '.ARW' AS name,
 'Copy' AS action FROM o""")
def plan_copy_template(spark, sf):
    sources = _sources(spark, sf).withColumn("dest", F.col("session_id").cast("string"))
    plan = P.plan_copy(sources, _listing(spark, sf), template="{date}_{seq}.{ext}", order=["o_orderdate", "image_id"])
    return plan.select("image_id", "dest", "name", "action")


@query("already_copied", """
SELECT o_orderkey AS image_id, o_orderpriority = '1-URGENT' AS copied_before FROM orders""")
def already_copied(spark, sf):
    rows = P.already_copied(_sources(spark, sf), _ledger(spark, sf), ["dest", "image_id"])
    return rows.select("image_id", "copied_before")


@query("destination_exists", f"WITH {_PLAN} SELECT image_id, taken, CAST(epoch_us(dm) AS BIGINT) AS sidecar_us FROM k")
def destination_exists(spark, sf):
    rows = _sources(spark, sf).withColumn("name", F.col("file_name"))
    out = P.destination_exists(rows, _listing(spark, sf), ["dest"])
    return out.select("image_id", "taken", F.unix_micros("dst_sidecar_mtime").alias("sidecar_us"))


@query("assign_free_suffix", """
WITH t AS (SELECT DISTINCT p_name, p_size + 1 AS k FROM part WHERE p_size > 0),
r AS (SELECT p_name, k, row_number() OVER (PARTITION BY p_name ORDER BY k) AS rn FROM t),
g AS (SELECT p_name, 2 + count(*) FILTER (WHERE k = rn + 1) AS free FROM r GROUP BY p_name)
SELECT p_name || '.jpg' AS name, p_name || '_' || CAST(free AS VARCHAR) || '.jpg' AS free_name FROM g""")
def assign_free_suffix(spark, sf):
    part = table(spark, sf, "part")
    taken = part.where("p_size > 0").select(F.concat("p_name", F.lit("_"), (F.col("p_size") + 1).cast("string"), F.lit(".jpg")).alias("name"))
    wanted = part.select(F.concat("p_name", F.lit(".jpg")).alias("name")).distinct()
    return P.assign_free_suffix(wanted, taken, []).select("name", "free_name")


@query("duplicate_names", """
WITH r AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_name) AS copies FROM part)
SELECT p_name AS name, copies, CAST(max(CASE WHEN rn = 1 THEN p_partkey END) AS VARCHAR) || '.ARW' AS first,
  CAST(max(CASE WHEN rn = 2 THEN p_partkey END) AS VARCHAR) || '.ARW' AS second FROM r WHERE copies > 1 GROUP BY p_name, copies""")
def duplicate_names(spark, sf):
    plan = table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.concat(F.col("p_partkey").cast("string"), F.lit(".ARW")).alias("file_name"), "p_partkey")
    return P.duplicate_names(plan, [], ["p_partkey"])


@query("plan_summary", _RENAME + """
SELECT session_id, count(*) AS jobs, CAST(coalesce(sum(CASE WHEN action LIKE 'Copy%' THEN size END), 0) AS BIGINT) AS total_bytes,
 count(*) FILTER (WHERE action = 'CopyRenamed') AS renamed, count(*) FILTER (WHERE action = 'Skip') AS skipped,
 count(*) FILTER (WHERE action = 'SidecarRefresh') AS refreshed,
 coalesce(sum(CASE WHEN action LIKE 'Copy%' THEN size END), 0) <= 1000000 AS fits FROM a GROUP BY session_id""")
def plan_summary(spark, sf):
    plan = P.plan_actions(_sources(spark, sf), _listing(spark, sf), _ledger(spark, sf), order=["image_id"])
    return P.plan_summary(plan, 1_000_000, ["session_id"])


@query("preview_names", f"SELECT {_NAME.format('o_orderkey')} AS name FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 3")
def preview_names(spark, sf):
    # Names of an overwriting plan do not depend on each other, so the first sources are enough.
    first = _sources(spark, sf).orderBy("o_orderdate", "image_id").limit(3)
    plan = P.plan_copy(first, _listing(spark, sf), mode="Overwrite", order=["image_id"])
    return P.preview_names(plan, ["o_orderdate", "image_id"])


@query("verify_copies", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS name,
  CASE WHEN l_linenumber = 1 THEN 'missing' WHEN l_linenumber = 2 THEN 'extra' WHEN l_linenumber = 3 THEN 'mismatch' ELSE 'match' END AS verdict FROM s""")
def verify_copies(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")]
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("/", *cols).alias("name"), "l_linenumber", F.col("l_quantity").cast("bigint").alias("size")).distinct()
    source = rows.where("l_linenumber <> 2").select("name", "size", F.md5("name").alias("hash"))
    changed = F.when(F.col("l_linenumber") == 3, F.md5(F.reverse("name"))).otherwise(F.md5("name"))
    copied = rows.where("l_linenumber <> 1").select("name", "size", changed.alias("hash"))
    return P.verify_copies(source, copied)


def _results(spark, sf):
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", (F.col("o_orderstatus") != "P").alias("ok"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Skip").when(F.col("o_orderpriority") == "2-HIGH", "SidecarRefresh")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "CopyRenamed").otherwise("Copy").alias("action"))


@query("copy_report", """
WITH r AS (SELECT o_custkey, o_orderstatus <> 'P' AS ok, o_orderpriority AS p FROM orders),
c AS (SELECT o_custkey, count(*) FILTER (WHERE ok AND p NOT IN ('1-URGENT', '2-HIGH')) AS copied,
  count(*) FILTER (WHERE ok AND p = '1-URGENT') AS skipped, count(*) FILTER (WHERE ok AND p = '2-HIGH') AS refreshed,
  count(*) FILTER (WHERE NOT ok) AS failed FROM r GROUP BY o_custkey)
SELECT *, copied > 0 AND failed = 0 AS verified FROM c""")
def copy_report(spark, sf):
    return P.copy_report(_results(spark, sf), by=["o_custkey"])


@query("copy_failures", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def copy_failures(spark, sf):
    return P.failures(_results(spark, sf)).select("o_custkey", "o_orderkey")


@query("run_report", """
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'view') AS from_cache,
  count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) / 4.0::DOUBLE AS files_per_second,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 2 ELSE 0 END AS exit_code FROM events GROUP BY user_id""")
def run_report(spark, sf):
    results = table(spark, sf, "events").select(
        "user_id", F.when(F.col("event_type") == "error", "Failed").otherwise("Loaded").alias("status"),
        (F.col("event_type") == "view").alias("from_cache"))
    return P.run_report(results, 4.0, ["user_id"])


@query("dedupe_output_names", """
SELECT p_partkey, p_name || CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN ''
  ELSE '_' || CAST(p_partkey AS VARCHAR) END || '.jpg' AS output FROM part""")
def dedupe_output_names_query(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(".ARW")).alias("name"))
    return dedupe_output_names(rows, "name", "p_partkey").select("p_partkey", "output")
