"""Scalar text and time rules, checked on names, prose, URLs and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions import capture as C
from sievelight.functions import text as X
from sievelight.functions.templates import expand_template
from sievelight.operators.lanes import Lanes, position, total
from sievelight.plans.registry import EVENT_FRAMES, event_frames, query, table


@query("sort_key", f"""WITH {EVENT_FRAMES}
SELECT image_id, CASE WHEN event_type <> 'signup' THEN capture_time || '.' ||
  rpad(substr(coalesce(CASE WHEN has_subsec THEN regexp_replace(CAST(user_id AS VARCHAR) || 'x' || CAST(camera AS VARCHAR) || '71', '[^0-9]', '', 'g') END, ''), 1, 3), 3, '0')
  END AS sort_key FROM frames""")
def sort_key(spark, sf):
    sub = F.concat(F.col("user_id").cast("string"), F.lit("x"), F.col("camera").cast("string"), F.lit("71"))
    time = F.when(F.col("event_type") != "signup", F.col("capture_time"))
    return event_frames(spark, sf).select(
        "image_id", C.sort_key(time, F.when(F.col("has_subsec"), sub)).alias("sort_key"))


@query("sort_key_ms", f"""WITH {EVENT_FRAMES}
SELECT image_id, CASE WHEN event_type <> 'error' THEN epoch_ms(strptime(capture_time, '%Y:%m:%d %H:%M:%S')) + 250 END AS ms
FROM frames""")
def sort_key_ms(spark, sf):
    # Error events carry text that is not a time at all.
    key = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("capture_time"))).otherwise(
        F.concat(F.col("capture_time"), F.lit(".25")))
    return event_frames(spark, sf).select("image_id", C.sort_key_ms(key).alias("ms"))


@query("capture_context", r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderstatus = 'F' THEN '000000' ELSE '174123' END AS time,
  CASE WHEN o_orderstatus = 'P' THEN '.' || o_orderpriority ELSE o_orderpriority END AS filename,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'ARW' END AS ext,
  CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'Clerk ' || CAST(o_custkey AS VARCHAR) END AS camera FROM orders""")
def capture_context(spark, sf):
    # Status F has an unset clock, so date and time come from the file's mtime.
    exif = F.when(F.col("o_orderstatus") == "F", "0000:00:00 00:00:00").otherwise(
        F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 17:41:23\t")))
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("."), F.col("o_orderpriority"))).otherwise(
        F.concat(F.col("o_orderpriority"), F.lit(".arw")))
    camera = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("  Clerk \t "), F.col("o_custkey").cast("string"), F.lit("\n")))
    ctx = C.capture_context(exif, F.col("o_orderdate"), name, camera)
    return table(spark, sf, "orders").select("o_orderkey", ctx.alias("c")).select("o_orderkey", "c.*")


@query("expand_template", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, '{x} ' || strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderpriority || '#' ||
  lpad(CAST(seq AS VARCHAR), CAST(greatest(length(CAST(n AS VARCHAR)), length(CAST(seq AS VARCHAR))) AS INTEGER), '0') || '/' ||
  lpad(CAST(seq AS VARCHAR), 4, '0') || '}.ARW' AS name FROM o""")
def expand_template_query(spark, sf):
    rows = Lanes(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    rows = rows.scan(seq=position(), n=total()).rows()
    ctx = C.capture_context(F.lit(None).cast("string"), F.col("o_orderdate"),
                            F.concat(F.col("o_orderpriority"), F.lit(".arw")), F.lit(None).cast("string"))
    rows = rows.withColumn("ctx", ctx)
    name = expand_template("{{x}} {date}_{filename}#{seq}/{seq:4}}.{ext}", F.col("ctx"), F.col("seq"), F.col("n"))
    return rows.select("o_orderkey", name.alias("name"))


@query("sanitize_text", r"""
SELECT doc_id, md5(trim(regexp_replace(nfc_normalize('  e' || chr(769) || chr(7) || text || chr(9) || ' '),
   '[\x00-\x1f\x7f-\x9f]', '', 'g'), ' ' || chr(160) || chr(8195) || chr(12288))) AS clean FROM documents""")
def sanitize_text(spark, sf):
    raw = F.concat(F.lit("  é\u0007"), F.col("text"), F.lit("\t "))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.sanitize_text(raw)).alias("clean"))


@query("casefold", """SELECT doc_id, md5(replace(lower(text), 'ß', 'ss')) AS folded FROM documents""")
def casefold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.casefold(F.col("text"))).alias("folded"))


@query("sidecar_path", "SELECT page_id, url || '.xmp' AS sidecar FROM pages")
def sidecar_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.sidecar_path(F.col("url")).alias("sidecar"))


@query("rating_to_pick", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Rejected' WHEN c_acctbal > 0 THEN 'Picked' ELSE 'Unmarked' END AS pick,
  CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal > 0 THEN 1 END AS rating FROM customer""")
def rating_to_pick(spark, sf):
    pick = C.rating_to_pick(F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", pick.alias("pick"), C.pick_to_rating(pick).alias("rating"))


@query("burst_seq", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS seq FROM events""")
def burst_seq(spark, sf):
    mode = F.when(F.col("event_type") == "view", 0).otherwise(2)
    return table(spark, sf, "events").select("event_id", C.burst_seq(mode, F.col("user_id")).alias("seq"))


@query("display_dims", """
WITH l AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber + 2 END AS o FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o BETWEEN 5 AND 8 THEN l_suppkey ELSE l_partkey END AS width,
       CASE WHEN o BETWEEN 5 AND 8 THEN l_partkey ELSE l_suppkey END AS height FROM l""")
def display_dims(spark, sf):
    turn = C.valid_orientation(F.when(F.col("l_linenumber") == 7, 42).otherwise(F.col("l_linenumber") + 2))
    dims = C.display_dims(F.col("l_partkey"), F.col("l_suppkey"), turn)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dims.alias("d")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "d.width", "d.height")


@query("normalize_make", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Sony' ELSE c_mktsegment END AS make FROM customer""")
def normalize_make(spark, sf):
    raw = F.when(F.col("c_mktsegment") == "MACHINERY", F.when(F.col("c_custkey") % 2 == 0, "SONY").otherwise("sOnY"))
    return table(spark, sf, "customer").select(
        "c_custkey", X.normalize_make(F.coalesce(raw, F.col("c_mktsegment"))).alias("make"))


@query("split_name", r"""
WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages UNION ALL
           SELECT page_id, '.' || regexp_extract(url, '([^/]*)$', 1) FROM pages)
SELECT page_id, name, CASE WHEN instr(name[2:], '.') > 0 THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem,
  CASE WHEN instr(name[2:], '.') > 0 THEN regexp_extract(name, '\.([^.]*)$', 1) ELSE '' END AS extension FROM n""")
def split_name(spark, sf):
    names = table(spark, sf, "pages").select("page_id", X.file_name(F.col("url")).alias("name"))
    names = names.unionAll(names.select("page_id", F.concat(F.lit("."), F.col("name"))))
    return names.withColumn("s", X.split_name(F.col("name"))).select("page_id", "name", "s.*")


@query("xml_escape", r"""
SELECT doc_id, md5(replace(replace(replace(regexp_replace(text || '<a&b>', '[\x00-\x1f\x7f-\x9f]', '', 'g'),
  '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM documents""")
def xml_escape(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.xml_escape(F.concat(F.col("text"), F.lit("<a&b>")))).alias("escaped"))


@query("first_value_wins", """
SELECT d.doc_id, CASE WHEN lang <> 'en' THEN lang WHEN quality IS NOT NULL THEN CAST(quality AS VARCHAR) ELSE source END AS value
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def first_value_wins(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    values = F.array(F.when(F.col("lang") == "en", " \t").otherwise(F.concat(F.lit(" "), F.col("lang"))),
                     F.col("quality").cast("string"), F.concat(F.col("source"), F.lit("\n")))
    return docs.select("doc_id", X.first_value_wins(values).alias("value"))


@query("destination_guard", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'source and target are one folder'
  WHEN page_id % 3 = 1 THEN 'target lies below the source' END AS reason FROM pages""")
def destination_guard(spark, sf):
    src = F.concat(F.lit("/card/"), F.regexp_replace("url", "[^A-Za-z0-9]", "_"))
    which = F.col("page_id") % 3
    dst = F.when(which == 0, F.concat(src, F.lit("//"))).when(which == 1, F.concat(src, F.lit("/./selects"))).otherwise(
        F.concat(src, F.lit("-selects")))
    return table(spark, sf, "pages").select("page_id", X.inside_folder(src, dst).alias("reason"))


@query("keyword_split", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS keywords FROM documents""")
def keyword_split(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.keyword_split(F.col("text")), "|").alias("keywords"))
