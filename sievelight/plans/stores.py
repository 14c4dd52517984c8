"""Listings, byte jobs, the cache and preview choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions.text import file_name
from sievelight.operators import cache as K
from sievelight.operators import previews as V
from sievelight.plans.registry import EVENT_FRAMES, dealt, event_frames, query, table
from sievelight.plans.synthetic import raw_file
from sievelight.schema import CACHE_VERSION
from sievelight.session import shared_folder
from sievelight.sources import files as L
from sievelight.sources import media as J
from sievelight.sources import sidecars as X
from sievelight.sources.folder import open_folders
from sievelight.sources.transfer import write_sidecar_files

# -- listings -------------------------------------------------------------------


@query("scan_files", r"""
SELECT CAST(page_id AS VARCHAR) || ' ' || regexp_extract(url, '([^/]*)$', 1) AS file_name, CAST(strlen(html) AS BIGINT) AS size, 'Placeholder' AS status
FROM pages""")
def scan_files(spark, sf):
    """Pages lie in a folder as files, named by their number and the end of their url; the folder is listed."""
    folder = shared_folder(spark, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.lit(" "), L.frame_columns(F.col("url"))["file_name"])
    files = table(spark, sf, "pages").select(F.concat(F.lit(f"{folder}/"), name).alias("path"), F.col("html").alias("xml"))
    write_sidecar_files(files).write.format("noop").mode("overwrite").save()
    found = L.scan_files(spark, folder)
    return found.where(F.col("session_id") == folder.removeprefix("file:")).select("file_name", "size", "status")


@query("frame_names", """
SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS session_id, regexp_extract(url, '([^/]*)$', 1) AS file_name FROM pages""")
def frame_names(spark, sf):
    """The naming rules of a listing."""
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in L.frame_columns(F.col("url")).items()])


_DOC_EXT = "CASE source WHEN 'src1' THEN 'ARW' WHEN 'src2' THEN 'nef' WHEN 'src3' THEN 'JPG' WHEN 'src4' THEN 'mp4' WHEN 'src5' THEN '' ELSE 'jpeg' END"


def _documents_as_files(spark, sf):
    """Names from documents: few stems per language, so RAW and JPEG meet."""
    ext = (F.when(F.col("source") == "src1", "ARW").when(F.col("source") == "src2", "nef").when(F.col("source") == "src3", "JPG")
           .when(F.col("source") == "src4", "mp4").when(F.col("source") == "src5", "").otherwise("jpeg"))
    stem = F.when(ext == "JPG", "Éa").otherwise("ÉA")
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("session_id"),
        F.concat(stem, (F.col("n_chars") % 400).cast("string"), F.lit("."), ext).alias("file_name"))


_DOC_FILES = f"""files AS (SELECT doc_id, lang AS session_id, CAST(n_chars % 400 AS VARCHAR) AS n, {_DOC_EXT} AS ext,
  CASE WHEN source = 'src3' THEN 'Éa' ELSE 'ÉA' END || CAST(n_chars % 400 AS VARCHAR) || '.' || {_DOC_EXT} AS file_name FROM documents)"""


@query("keep_image_extensions", f"WITH {_DOC_FILES} SELECT doc_id, file_name FROM files WHERE ext NOT IN ('mp4', '')")
def keep_image_extensions(spark, sf):
    return L.keep_image_extensions(_documents_as_files(spark, sf)).select("doc_id", "file_name")


@query("hide_paired", f"""WITH {_DOC_FILES} SELECT doc_id, file_name FROM files f
WHERE ext NOT IN ('JPG', 'jpeg') OR NOT EXISTS (SELECT 1 FROM files r WHERE r.session_id = f.session_id AND r.n = f.n AND r.ext IN ('ARW', 'nef'))""")
def hide_paired(spark, sf):
    return L.hide_paired(_documents_as_files(spark, sf)).select("doc_id", "file_name")


@query("split_failed", """
SELECT event_type = 'error' AS failed, user_id, count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS reasons
FROM events GROUP BY ALL""")
def split_failed(spark, sf):
    read = table(spark, sf, "events").withColumn("error", F.when(F.col("event_type") == "error", F.col("props")))
    good, failed = L.split_failed(L.load_status(read))
    both = good.withColumn("failed", F.lit(False)).unionByName(failed.withColumn("failed", F.lit(True)))
    return both.groupBy("failed", "user_id").agg(F.count(F.lit(1)).alias("rows"), F.count("reason").alias("reasons"))


# -- byte jobs on files built from events ------------------------------------------

def _event_files(spark, sf):
    rows = dealt(event_frames(spark, sf))
    damaged = F.col("event_type") == "error"
    content = raw_file(
        F.when(F.col("camera") == 0, "SONY").otherwise("Canon"), F.concat(F.lit(" ILCE-"), F.col("camera").cast("string")),
        F.col("user_id") % 10, F.col("capture_time"), (F.col("user_id") % 100).cast("string"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")),
        F.when(F.col("event_type") == "view", 0).otherwise(2), F.col("user_id") % 97,
        1000 + F.col("user_id") % 1000, 700 + F.col("camera"), F.col("event_type") != "click")
    # Error events are files that are no image at all.
    return rows.select(
        F.col("file_name").alias("path"), F.when(damaged, F.lit("no image").cast("binary")).otherwise(content).alias("content"))


@query("extract_capture_metadata", f"""WITH {EVENT_FRAMES}, ok AS (SELECT *, event_type <> 'error' AS fine FROM frames)
SELECT file_name AS path, CASE WHEN fine THEN CASE WHEN camera = 0 THEN 'Sony' ELSE 'Canon' END END AS make,
  CASE WHEN fine THEN 'ILCE-' || CAST(camera AS VARCHAR) END AS model, CASE WHEN fine THEN 'S' || CAST(user_id AS VARCHAR) END AS serial,
  CASE WHEN fine THEN capture_time END AS capture_time, CASE WHEN fine THEN CAST(user_id % 100 AS VARCHAR) END AS subsec,
  CASE WHEN fine THEN CASE WHEN event_type = 'view' THEN 0 ELSE user_id % 97 + 1 END END AS sequence_number,
  CASE WHEN fine AND user_id % 10 BETWEEN 1 AND 8 THEN user_id % 10 ELSE 1 END AS orientation,
  CASE WHEN NOT fine THEN 'neither TIFF nor JPEG data' END AS error FROM ok""")
def extract_capture_metadata(spark, sf):
    return J.extract_capture_metadata(_event_files(spark, sf), content="content")


@query("index_previews", f"""WITH {EVENT_FRAMES}
SELECT file_name AS path, unnest([306, 320]) AS "offset", unnest([14, 28]) AS len, 1000 + user_id % 1000 AS width, 700 + camera AS height,
  FALSE AS whole_file, CASE WHEN user_id % 10 BETWEEN 1 AND 8 THEN user_id % 10 ELSE 1 END AS orientation
FROM frames WHERE event_type <> 'error'""")
def index_previews(spark, sf):
    return J.index_previews(_event_files(spark, sf), content="content")[0]


@query("index_previews_errors", f"""WITH {EVENT_FRAMES}
SELECT file_name AS path, 'neither TIFF nor JPEG data' AS error FROM frames WHERE event_type = 'error'""")
def index_previews_errors(spark, sf):
    return J.index_previews(_event_files(spark, sf), content="content")[1]


@query("audit_jpegs", f"""WITH {EVENT_FRAMES}
SELECT file_name AS path, user_id % 1000 + 1000 AS width, event_type = 'click' AS truncated, user_id > 60 AS implausible
FROM frames WHERE event_type <> 'error'""")
def audit_jpegs(spark, sf):
    files = _event_files(spark, sf).join(event_frames(spark, sf).select(F.col("file_name").alias("path"), "user_id", "event_type"), "path")
    claims = files.where("event_type <> 'error'").select(
        "path", "content", F.lit(306).cast("bigint").alias("offset"), F.lit(14).cast("bigint").alias("len"),
        (1000 + F.col("user_id") % 1000).cast("int").alias("width"),
        F.when(F.col("user_id") > 60, 1_000_000).otherwise(700).alias("height"))
    return J.audit_jpegs(claims, content="content").select("path", F.col("width").cast("bigint").alias("width"), "truncated", "implausible")


@query("folders_opened", """
WITH f AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal < 0 AS damaged, s_suppkey % 3 = 0 AS rated FROM supplier)
SELECT CAST(n AS VARCHAR) AS folder, CAST(k AS VARCHAR) || '.ARW' AS file_name, CASE WHEN damaged THEN 'Failed' ELSE 'Loaded' END AS status,
  CASE WHEN NOT damaged THEN 'ILCE-' || CAST(n % 5 AS VARCHAR) END AS model, CASE WHEN NOT damaged THEN 'S' || CAST(k % 1000 AS VARCHAR) END AS camera,
  CASE WHEN NOT damaged THEN '2024:01:' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || ' 10:00:00' END AS capture_time,
  CASE WHEN rated AND k % 2 = 0 THEN 'Picked' WHEN rated THEN 'Rejected' ELSE 'Unmarked' END AS pick,
  CASE WHEN rated THEN 'nation ' || CAST(n AS VARCHAR) ELSE '' END AS keywords, count(*) OVER () AS first_read, 0 AS second_read FROM f""")
def folders_opened(spark, sf):
    """Suppliers as RAW files in one folder per nation, some paired or with a sidecar, opened twice: the second time nothing is read."""
    home = shared_folder(spark, "card")
    rows = dealt(table(spark, sf, "supplier")).withColumns({"k": F.col("s_suppkey"), "n": F.col("s_nationkey")})
    place = F.concat(F.lit(f"{home}/"), F.col("n").cast("string"), F.lit("/"), F.col("k").cast("string"))
    raw = raw_file(F.lit("SONY"), F.concat(F.lit("ILCE-"), (F.col("n") % 5).cast("string")), F.lit(1),
                   F.concat(F.lit("2024:01:"), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00")), F.lit("5"),
                   F.concat(F.lit("S"), (F.col("k") % 1000).cast("string")), F.lit(2), F.lit(7), F.lit(1000), F.lit(700), F.lit(True))
    content = F.when(F.col("s_acctbal") < 0, F.lit("no image").cast("binary")).otherwise(raw)
    pick = F.when(F.col("k") % 2 == 0, "Picked").otherwise("Rejected")
    car = X.render_sidecar(pick, F.array(F.concat(F.lit("nation "), F.col("n").cast("string"))), {}).cast("binary")
    files = rows.select(F.concat(place, F.lit(".ARW")).alias("path"), content.alias("xml")).unionByName(
        rows.where("k % 3 = 0").select(F.concat(place, F.lit(".ARW.xmp")), car.alias("xml")).toDF("path", "xml")).unionByName(
        rows.where("k % 2 = 1").select(F.concat(place, F.lit(".jpg")), F.lit("jpeg").cast("binary")).toDF("path", "xml"))
    write_sidecar_files(files).write.format("noop").mode("overwrite").save()
    folders = [f"{home}/{r.n}" for r in rows.select("n").distinct().collect()]  # one per nation
    cache = shared_folder(spark, "cache")
    _, first = open_folders(spark, folders, cache, now=1, buckets=4)
    frames, second = open_folders(spark, folders, cache, now=2, buckets=4)
    return frames.select(
        file_name(F.col("session_id")).alias("folder"), "file_name", "status", "model", "camera", "capture_time", "pick",
        F.array_join("keywords", "|").alias("keywords"), F.lit(first.count()).cast("bigint").alias("first_read"), F.lit(second.count()).alias("second_read"))


# -- cache ----------------------------------------------------------------------

def _lines(spark, sf, mtime):
    """Lines as cache rows; an order-line key that repeats keeps its lowest part."""
    part = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("size"), F.min("l_shipdate").alias("shipped"), F.min("l_returnflag").alias("flag"),
        F.min("l_quantity").alias("qty"))
    return part.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), "size", mtime.alias("mtime_ns"), "flag", "qty", "l_linenumber")


_CACHE_LINES = """lines AS (SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS path, l_linenumber,
  min(l_partkey) AS size, min(l_shipdate) AS shipped, min(l_returnflag) AS flag, min(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey, l_linenumber),
 now AS (SELECT *, CASE WHEN flag <> 'N' THEN epoch_us(shipped) * 1000 END AS mtime_ns FROM lines),
 cache AS (SELECT *, CASE WHEN qty < 10 THEN size + 1 ELSE size END AS csize, CASE WHEN qty > 45 THEN '{broken' ELSE '{"make": "x"}' END AS capture,
   CASE WHEN l_linenumber = 7 THEN 2 ELSE 3 END AS version FROM now)"""


def _cache_tables(spark, sf):
    stamp = F.when(F.col("flag") != "N", F.unix_micros("shipped") * 1000)
    now = _lines(spark, sf, stamp)
    cache = now.select(
        "path", F.when(F.col("qty") < 10, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ns",
        F.when(F.col("qty") > 45, "{broken").otherwise('{"make": "x"}').alias("capture"),
        F.col("qty").cast("bigint").alias("payload_bytes"), F.col("l_linenumber").cast("bigint").alias("last_used"),
        F.when(F.col("l_linenumber") == 7, 2).otherwise(CACHE_VERSION).alias("schema_version"))
    return now, cache


@query("cache_split", f"""WITH {_CACHE_LINES}
SELECT path, mtime_ns IS NOT NULL AND csize = size AND qty <= 45 AND version = 3 AS hit FROM cache""")
def cache_split(spark, sf):
    frames, cache = _cache_tables(spark, sf)
    hits, misses = K.cache_split(frames, cache, K.readable_json(F.col("capture"), "make string"))
    return hits.select("path", F.lit(True).alias("hit")).unionByName(misses.select("path", F.lit(False).alias("hit")))


@query("upsert_cache", f"""WITH {_CACHE_LINES}, c AS (SELECT *, mtime_ns IS NOT NULL AND csize = size AND qty <= 45 AND version = 3 AS hit FROM cache),
 stored AS (SELECT *, NOT hit AND mtime_ns IS NOT NULL AS fresh FROM c)
SELECT path, CASE WHEN fresh THEN size ELSE csize END AS size, CASE WHEN fresh THEN NULL ELSE capture END AS capture,
  CASE WHEN fresh OR hit THEN 99 ELSE l_linenumber END AS last_used FROM stored WHERE fresh OR version = 3""")
def upsert_cache(spark, sf):
    frames, cache = _cache_tables(spark, sf)
    hits, misses = K.cache_split(frames, cache, K.readable_json(F.col("capture"), "make string"))
    # Every miss is read again; here each read fails, so its summary is NULL.
    fresh = misses.select("path", "size", "mtime_ns", F.lit(None).cast("string").alias("capture"), F.lit(0).cast("bigint").alias("payload_bytes"))
    return K.upsert_cache(cache, fresh, hits, now=99).select("path", "size", "capture", "last_used")


@query("save_cache", f"""WITH {_CACHE_LINES}, c AS (SELECT *, mtime_ns IS NOT NULL AND csize = size AND qty <= 45 AND version = 3 AS hit FROM cache),
 stored AS (SELECT *, NOT hit AND mtime_ns IS NOT NULL AS fresh FROM c)
SELECT path, CASE WHEN fresh THEN size ELSE csize END AS size, CASE WHEN fresh OR version <> 3 THEN NULL ELSE capture END AS capture,
  CASE WHEN fresh OR hit THEN 99 ELSE l_linenumber END AS last_used FROM stored WHERE fresh OR version = 3""")
def save_cache(spark, sf):
    """The same through the stored table, which the job reads while it replaces it."""
    frames, cache = _cache_tables(spark, sf)
    root = shared_folder(spark, "cache")
    none = cache.limit(0)
    K.save_cache(spark, root, cache.where(f"schema_version = {CACHE_VERSION} AND mtime_ns IS NOT NULL"), none, now=0, buckets=8)
    # Rows as an earlier run left them: their own times of use, and those without an mtime, which a save never stores.
    old = cache.where(f"schema_version = {CACHE_VERSION}").withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(8)).cast("int"))
    old.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
    hits, misses = K.cache_split(frames, K.read_cache(spark, root), K.readable_json(F.col("capture"), "make string"))
    known, fresh = shared_folder(spark, "hits"), shared_folder(spark, "fresh")
    hits.write.parquet(known)
    misses.select("path", "size", "mtime_ns", F.lit(None).cast("string").alias("capture"), F.lit(0).cast("bigint").alias("payload_bytes")).write.parquet(fresh)
    K.save_cache(spark, root, spark.read.parquet(fresh), spark.read.parquet(known), now=99, buckets=8)
    return K.read_cache(spark, root).select("path", "size", "capture", "last_used")


@query("stored_bytes", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS rows FROM documents GROUP BY source")
def stored_bytes(spark, sf):
    return K.stored_bytes(table(spark, sf, "documents"), "n_chars", ["source"])


_EVICT = """WITH t AS (SELECT sum(n_chars) AS total FROM documents),
o AS (SELECT doc_id, row_number() OVER w - 1 AS i, sum(n_chars) OVER w - n_chars AS past FROM documents WINDOW w AS (ORDER BY lang, doc_id)),
r AS (SELECT (i // 64) AS round, min(past) AS past FROM o GROUP BY 1)
SELECT doc_id, (SELECT total FROM t) - r.past > 300000 AS evict FROM o JOIN r ON r.round = o.i // 64"""


@query("lru_evict", _EVICT)
def lru_evict(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return K.lru_evict(rows, 300_000, size="n_chars", used="lang", path="doc_id").select("doc_id", "evict")


@query("lru_evict_pinned", """
WITH o AS (SELECT doc_id, source = 'src0' AND lang = 'de' AS pin, row_number() OVER w AS i, count(*) OVER () AS n,
   sum(n_chars) OVER () - (sum(n_chars) OVER w - n_chars) > 250000 AS due
   FROM documents WINDOW w AS (ORDER BY source = 'src0' AND lang = 'de', n_chars, doc_id))
SELECT doc_id, due AND NOT pin AND i < n AS evict FROM o""")
def lru_evict_pinned(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    pin = (F.col("source") == "src0") & (F.col("lang") == "de")
    return K.lru_evict(rows, 250_000, pinned=pin, size="n_chars", used="n_chars", path="doc_id").select("doc_id", "evict")


# -- previews --------------------------------------------------------------------

def _line_previews(spark, sf):
    """Lines as previews of their order: width from the part, height from the quantity."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_extendedprice").cast("bigint").alias("offset"),
        F.col("l_partkey").alias("len"), (F.col("l_suppkey") * 40 + 100).cast("int").alias("width"),
        (F.col("l_quantity") * 50).cast("int").alias("height"), (F.col("l_tax") == 0.08).alias("whole_file"),
        F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_partkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate").alias("ord"))


_PREVIEWS = """p AS (SELECT l_orderkey AS path, CAST(trunc(l_extendedprice) AS BIGINT) AS o, l_partkey AS len,
   CAST(l_suppkey * 40 + 100 AS INTEGER) AS width, CAST(l_quantity * 50 AS INTEGER) AS height, l_tax = 0.08 AS whole FROM lineitem),
 q AS (SELECT *, CAST(width AS BIGINT) * height AS px FROM p),
 g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY whole DESC,
     CASE WHEN whole THEN 0 WHEN px BETWEEN 100000 AND 2100000 THEN 1 WHEN px > 2100000 THEN 2 ELSE 3 END,
     CASE WHEN whole THEN -o WHEN px <= 2100000 THEN -px ELSE px END, CASE WHEN whole THEN -len WHEN px <= 2100000 THEN len ELSE -len END,
     CASE WHEN whole THEN -width ELSE o END) AS rn FROM q WHERE whole OR px >= 100000),
 f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY whole DESC, CASE WHEN whole THEN -o ELSE -px END, -len, o) AS rn FROM q WHERE whole OR px >= 100000)"""


@query("pick_grid_source", f"""WITH {_PREVIEWS} SELECT path, o AS "offset", len, width, height FROM g WHERE rn = 1""")
def pick_grid_source(spark, sf):
    return V.pick_preview(_line_previews(spark, sf), "grid")


@query("pick_fullres", f"""WITH {_PREVIEWS} SELECT path, o AS "offset", len, width, height FROM f WHERE rn = 1""")
def pick_fullres(spark, sf):
    return V.pick_preview(_line_previews(spark, sf), "full")


@query("pick_for_size", f"""WITH {_PREVIEWS}, a AS (SELECT g.path, g.o, g.len, g.width, g.height, f.o AS fo, f.len AS fl, f.width AS fw, f.height AS fh,
  greatest(g.width, g.height) AS gl, greatest(f.width, f.height) AS fll FROM g JOIN f ON f.path = g.path WHERE g.rn = 1 AND f.rn = 1),
 b AS (SELECT *, gl * 1.25 >= 2500 OR fll <= gl AS small FROM a)
SELECT path, CASE WHEN small THEN o ELSE fo END AS "offset", CASE WHEN small THEN len ELSE fl END AS len,
  CASE WHEN small THEN width ELSE fw END AS width, CASE WHEN small THEN height ELSE fh END AS height,
  CASE WHEN small THEN gl ELSE fll END >= fll AS terminal FROM b""")
def pick_for_size(spark, sf):
    return V.pick_preview(_line_previews(spark, sf), target_long=2500)


@query("usable_previews", """
WITH p AS (SELECT l_orderkey AS path, l_linenumber AS "offset", l_partkey AS len, l_quantity, l_suppkey, 2000 AS size FROM lineitem WHERE l_linenumber + l_partkey <= 2000 AND l_partkey > 0)
SELECT path, "offset", min(len * 1000 + l_suppkey) AS first FROM p GROUP BY path, "offset" """)
def usable_previews(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("bigint").alias("offset"), F.col("l_partkey").alias("len"),
        F.lit(2000).alias("size"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"))
    return V.usable_previews(rows).select("path", "offset", F.col("ord").alias("first"))
