"""Edit streams over ``events``: drained streams and the batch form of the same plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.plans.bursts import BURSTS, GAP_US, SECOND_US
from sievelight.plans.registry import event_frames, query, table
from sievelight.session import shared_folder
from sievelight.sources.transfer import write_sidecar_files
from sievelight.streaming import edits as E
from sievelight.streaming import live as L
from sievelight.streaming.tables import FailureLedger, LateRows, StateTable

MINUTE_MS = 60_000


def _edits(events):
    """Users are paths; views and sign-ups mark, clicks set keywords, the rest are full edits."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "mark").when(F.col("event_type") == "click", "keywords").otherwise("iptc")
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"), kind.alias("kind"),
        F.when(F.col("event_type") == "view", "Picked").when(F.col("event_type") == "signup", "Rejected").alias("pick"),
        F.when(kind != "mark", F.array("event_type", F.get_json_object("props", "$.k"))).alias("keywords"),
        F.when(kind == "iptc", F.struct(F.col("value").cast("string").alias("title"))).alias("fields"))


_EDITS = """
  edits AS (SELECT event_id AS seq, ts, user_id AS path,
    CASE WHEN event_type IN ('view', 'signup') THEN 'mark' WHEN event_type = 'click' THEN 'keywords' ELSE 'iptc' END AS kind,
    CASE event_type WHEN 'view' THEN 'Picked' WHEN 'signup' THEN 'Rejected' END AS pick,
    CASE WHEN event_type NOT IN ('view', 'signup') THEN event_type || '|' || regexp_extract(props, '([0-9]+)', 1) END AS keywords,
    CASE WHEN event_type IN ('purchase', 'error') THEN CAST(value AS VARCHAR) END AS title FROM events)"""
_MERGED = """arg_max(keywords, seq) AS keywords, arg_max(title, seq) FILTER (WHERE kind = 'iptc') AS title,
   count(*) FILTER (WHERE kind = 'iptc') > 0 AS sets_fields, count(*) AS edits, max(seq) AS last_seq"""


def _flat(writes):
    return writes.withColumns({"keywords": F.array_join("keywords", "|"), "title": F.col("fields.title")}).drop("fields")


@query("coalesce_edits", f"""WITH {_EDITS}, s AS (SELECT *, CASE WHEN kind = 'mark' THEN 'pick' ELSE 'metadata' END AS slot FROM edits),
 l AS (SELECT *, lag(ts) OVER (PARTITION BY path, slot ORDER BY ts, seq) AS p FROM s),
 r AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > {240 * MINUTE_MS * 1000} THEN 1 ELSE 0 END) OVER (PARTITION BY path, slot ORDER BY ts, seq) AS run FROM l)
SELECT path, slot, arg_max(pick, seq) AS pick, {_MERGED}, epoch_us(max(ts)) + {240 * MINUTE_MS * 1000} AS write_us FROM r GROUP BY path, slot, run""")
def coalesce_edits(spark, sf):
    # Edits of one user are hours apart, so the pause is four hours here.
    writes = E.coalesce_edits(_edits(table(spark, sf, "events")), 240 * MINUTE_MS)
    return _flat(writes.withColumn("write_us", F.unix_micros("write_at")).drop("write_at"))


@query("coalesce_edits_span", f"""WITH {_EDITS}, s AS (SELECT *, CASE WHEN kind = 'mark' THEN 'pick' ELSE 'metadata' END AS slot FROM edits),
 l AS (SELECT *, lag(ts) OVER (PARTITION BY path, slot ORDER BY ts, seq) AS p FROM s),
 r AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > {2880 * MINUTE_MS * 1000} THEN 1 ELSE 0 END) OVER (PARTITION BY path, slot ORDER BY ts, seq) AS run FROM l),
 f AS (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY path, slot, run) AS first FROM r),
 q AS (SELECT *, (epoch_us(ts) - first) // {4320 * MINUTE_MS * 1000} AS part FROM f)
SELECT path, slot, arg_max(pick, seq) AS pick, {_MERGED},
  least(epoch_us(max(ts)) + {2880 * MINUTE_MS * 1000}, first + (part + 1) * {4320 * MINUTE_MS * 1000}) AS write_us FROM q GROUP BY path, slot, run, first, part""")
def coalesce_edits_span(spark, sf):
    """A pause of two days, and no write later than three days after its first edit; drained from a stream."""
    writes = _drain_in_order(spark, _edits(table(spark, sf, "events")), "ts", lambda stream, watermark: E.coalesce_edits(
        stream, 2880 * MINUTE_MS, watermark, max_span_ms=4320 * MINUTE_MS))
    return _flat(writes.where("path <> -1").withColumn("write_us", F.unix_micros("write_at")).drop("write_at"))


@query("merge_keyword_edits", f"WITH {_EDITS} SELECT path, {_MERGED} FROM edits WHERE kind <> 'mark' GROUP BY path")
def merge_keyword_edits(spark, sf):
    return _flat(E.merge_keyword_edits(_edits(table(spark, sf, "events")), ["path"]))


_STATE = """SELECT path, coalesce(arg_max(pick, seq) FILTER (WHERE kind = 'mark'), 'Unmarked') AS pick,
  arg_max(keywords, seq) FILTER (WHERE kind <> 'mark') AS keywords, arg_max(title, seq) FILTER (WHERE kind = 'iptc') AS title FROM edits GROUP BY path"""


def _drain(spark, sf, sink, prepare=lambda rows: rows):
    """Run ``events`` as a stream of shuffled micro-batches into a foreachBatch sink."""
    events = table(spark, sf, "events")
    folder = shared_folder(spark, "events")
    # Hash partitions mix old and new events, so late edits reach every batch.
    events.repartition(3, F.xxhash64("event_id")).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = prepare(stream).writeStream.foreachBatch(sink).option("checkpointLocation", shared_folder(spark, "progress"))
    run.trigger(availableNow=True).start().awaitTermination()


def _drain_in_order(spark, rows, time, transform, slices=3):
    """Rows as a stream of slices of time, any order within a slice, through ``transform(stream, watermark)``; what came out.

    Two rows of the key -1, long after all others, make the watermark pass everything.
    """
    folder, done = shared_folder(spark, "slices"), shared_folder(spark, "drained")
    low, high = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    width = (high - low) // slices + 1
    for i in range(slices):
        rows.where(F.floor((F.unix_micros(time) - low) / width) == i).write.parquet(f"{folder}/slice={i}")
    for i in (slices, slices + 1):
        at = F.timestamp_micros(F.lit(high + (i - slices + 1) * 10 * (width + 86_400_000_000)))
        plain = ("string", "bigint", "int", "double")
        last = spark.range(1).select(*[(at if f.name == time else F.lit(-1 if f.dataType.simpleString() in plain else None)).cast(f.dataType).alias(f.name)
                                       for f in rows.schema.fields])
        last.write.parquet(f"{folder}/slice={i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/*")
    run = transform(stream, f"{width} microseconds").writeStream.format("parquet").option("path", done)
    run.option("checkpointLocation", shared_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(done)


def _state_table(spark, sf):
    state = StateTable(spark, shared_folder(spark, "state"), _edits(table(spark, sf, "events")).schema, buckets=4)
    _drain(spark, sf, state.upsert, _edits)
    return state


@query("latest_state", f"WITH {_EDITS} {_STATE}")
def latest_state(spark, sf):
    rows = E.current_state(_state_table(spark, sf).read())
    return rows.select("path", "pick", F.array_join("keywords", "|").alias("keywords"), F.col("fields.title").alias("title"))


@query("late_edits", f"WITH {_EDITS} {_STATE}")
def late_edits(spark, sf):
    """Edits in any order, split by the watermark: state folded from those on time, then from the side table, undoes nothing newer."""
    log = _edits(table(spark, sf, "events"))
    split = LateRows(spark, shared_folder(spark, "late"), log.schema, delay_ms=240 * MINUTE_MS)
    _drain(spark, sf, split.append, _edits)
    rows = E.current_state(E.merge_states(E.fold_edits(split.on_time()).unionByName(E.fold_edits(split.late()))))
    return rows.select("path", "pick", F.array_join("keywords", "|").alias("keywords"), F.col("fields.title").alias("title"))


@query("live_counts", f"""WITH {_EDITS}, s AS ({_STATE}) SELECT count(*) AS "all", count(*) FILTER (WHERE pick = 'Picked') AS picked,
  count(*) FILTER (WHERE pick = 'Rejected') AS rejected, count(*) FILTER (WHERE pick = 'Unmarked') AS unmarked FROM s""")
def live_counts(spark, sf):
    return _state_table(spark, sf).live_counts()


@query("failure_ledger", "SELECT user_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY user_id")
def failure_ledger(spark, sf):
    ledger = FailureLedger(spark, shared_folder(spark, "failures"), table(spark, sf, "events").schema)
    _drain(spark, sf, lambda batch, i: ledger.append(batch.withColumn("ok", F.col("event_type") != "error"), i))
    return ledger.counts(["user_id"])


@query("flush_barrier", f"""WITH {_EDITS}, s AS (SELECT *, CASE WHEN kind = 'mark' THEN 'pick' ELSE 'metadata' END AS slot FROM edits),
 l AS (SELECT *, lag(ts) OVER (PARTITION BY path, slot ORDER BY ts, seq) AS p FROM s),
 r AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > {240 * MINUTE_MS * 1000} THEN 1 ELSE 0 END) OVER (PARTITION BY path, slot ORDER BY ts, seq) AS run FROM l)
SELECT path, slot, max(seq) AS last_seq FROM r GROUP BY path, slot, run""")
def flush_barrier(spark, sf):
    """Writes the drained stream has emitted, and the open ones the barrier adds: nothing is lost, nothing twice."""
    log = _edits(table(spark, sf, "events"))
    folder, done = shared_folder(spark, "events"), shared_folder(spark, "writes")
    table(spark, sf, "events").write.parquet(folder)
    stream = _edits(spark.readStream.schema(table(spark, sf, "events").schema).parquet(folder))
    writes = E.coalesce_edits(stream, 240 * MINUTE_MS).select("path", "slot", "last_seq")
    run = (writes.writeStream.format("parquet").option("path", done)
           .option("checkpointLocation", shared_folder(spark, "progress")).start())
    try:
        written = lambda: spark.read.schema("path long, slot string, last_seq long").parquet(done)
        run.processAllAvailable()
        still_open = L.flush_barrier(run, log, written(), 240 * MINUTE_MS).select("path", "slot", "last_seq")
    finally:
        run.stop()
    return written().unionByName(still_open)


@query("stream_bursts", f"""WITH {BURSTS}
SELECT session_id, camera, min(time_us) AS first_us, max(time_us) AS last_us, count(*) AS burst_size FROM g WHERE burst_id IS NOT NULL
GROUP BY session_id, camera, burst_id""")
def stream_bursts(spark, sf):
    """The drained stream has the bursts of the batch operator, with sequence numbers."""
    frames = event_frames(spark, sf).select("session_id", "camera", "mtime", "has_subsec", "seq", "image_id")
    found = _drain_in_order(spark, frames, "mtime", lambda stream, watermark: L.stream_bursts(
        stream, time="mtime", session=["session_id"], tie="image_id", max_gap_ms=GAP_US // 1000, second_ms=SECOND_US // 1000, watermark=watermark))
    return found.withColumn("camera", F.col("camera").cast("long"))


_REQUESTS = """
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS p FROM events),
 r AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 172800000000 THEN 1 ELSE 0 END)
   OVER (PARTITION BY user_id, event_type ORDER BY ts) AS run FROM l)
SELECT user_id, event_type, min(ts) AS first FROM r GROUP BY user_id, event_type, run"""


def _requests(rows, watermark=None):
    kept = L.dedupe_requests(rows, ["user_id", "event_type"], "ts", "2 days", watermark)
    return kept.select("user_id", "event_type", F.col("ts").alias("first"))


@query("dedupe_requests", _REQUESTS)
def dedupe_requests(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts")
    return _drain_in_order(spark, rows, "ts", _requests).where("user_id <> -1")


@query("dedupe_requests_batch", _REQUESTS)
def dedupe_requests_batch(spark, sf):
    return _requests(table(spark, sf, "events").select("user_id", "event_type", "ts"))


@query("watch_folder", "SELECT CAST(doc_id AS VARCHAR) || '.txt' AS file_name, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def watch_folder(spark, sf):
    """Texts land in a folder as files; the watching stream reports each with its size."""
    folder, seen = shared_folder(spark, "watched"), shared_folder(spark, "seen")
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("xml"))
    write_sidecar_files(docs).write.format("noop").mode("overwrite").save()
    run = L.watch_folder(spark, folder).select("file_name", "size").writeStream.format("parquet").option("path", seen)
    run.option("checkpointLocation", shared_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file_name string, size long").parquet(seen)
