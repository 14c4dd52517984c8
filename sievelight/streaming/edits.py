"""The edit log: debounced writes and the fold into current state.

An edit is (seq, ts, path, kind, pick, keywords, fields). ``kind`` is mark,
keywords or iptc; marks fill the pick slot of a path, the other two its metadata
slot. A higher ``seq`` is the newer edit, whatever order rows arrive in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievelight.operators.lanes import Lanes, last_seen, previous, running
from sievelight.sources.jobs import ship_package

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_MARK, _FULL = "kind = 'mark'", "kind = 'iptc'"


def slot() -> Column:
    return F.when(F.expr(_MARK), "pick").otherwise("metadata")


def merged_values() -> list[Column]:
    """Aggregates of one slot's edits: the newest value wins, and a keyword-only
    edit renews the keywords of a pending full edit without dropping its fields."""
    full = F.when(F.expr(_FULL), F.col("seq"))
    return [
        F.max_by("pick", "seq").alias("pick"), F.max_by("keywords", "seq").alias("keywords"),
        F.max_by("fields", full).alias("fields"), F.max(full).isNotNull().alias("sets_fields"),
        F.count(F.lit(1)).alias("edits"), F.max("seq").alias("last_seq"),
    ]


def merge_keyword_edits(edits: DataFrame, keys: list[str]) -> DataFrame:
    """One metadata write per ``keys`` out of its keyword and full edits."""
    return edits.where(f"not ({_MARK})").groupBy(*keys).agg(*merged_values()).drop("pick")


def coalesce_edits(edits: DataFrame, gap_ms: int = 700, watermark: str = "10 seconds", max_span_ms: int | None = None) -> DataFrame:
    """One write per (path, slot) once its edits pause for longer than ``gap_ms``.

    A stream uses a session window and emits in append mode; rows later than
    ``watermark`` are dropped there, so keep the raw log too. A batch cuts the
    log at the same pauses with a lane per (path, slot), where one path with most
    of the edits still spreads over many tasks. A path that is edited without pause would be written at its end only: with
    ``max_span_ms`` a run is also cut at each multiple of it after the run's first edit, by a second scan in a batch and by state with a timer in a stream.
    """
    rows = edits.withColumn("slot", slot())
    if edits.isStreaming and max_span_ms:
        return spanned_writes(rows.withWatermark("ts", watermark), gap_ms, max_span_ms)
    if edits.isStreaming:
        window = F.session_window("ts", f"{gap_ms} milliseconds")
        writes = rows.withWatermark("ts", watermark).groupBy("path", "slot", window).agg(*merged_values())
        return writes.withColumn("write_at", F.col("session_window.end")).drop("session_window")
    lane = Lanes(rows, ["path", "slot"], ["ts", "seq"]).scan(_before=previous(F.col("ts")))
    pause = F.coalesce(F.unix_micros("ts") - F.unix_micros("_before") > gap_ms * 1000, F.lit(True))
    lane = lane.with_columns(_pause=pause).scan(_run=running(F.col("_pause").cast("int")))
    part, due = [], F.unix_micros("_last") + gap_ms * 1000
    if max_span_ms:
        start = F.when(F.col("_pause"), F.unix_micros("ts"))
        lane = lane.scan(_start=last_seen(start))
        first = F.coalesce(start, F.col("_start"))
        lane = lane.with_columns(_first=first, _part=F.floor((F.unix_micros("ts") - first) / (max_span_ms * 1000)))
        part, due = ["_first", "_part"], F.least(due, F.col("_first") + (F.col("_part") + 1) * max_span_ms * 1000)
    writes = lane.rows().groupBy("path", "slot", "_run", *part).agg(*merged_values(), F.max("ts").alias("_last"))
    return writes.withColumn("write_at", F.timestamp_micros(due.cast("long"))).drop("_run", "_last", *part)


_ROWS = T.StructType([T.StructField("rows", T.StringType())])
_EDIT = ["path", "slot", "us", "seq", "full", "pick", "keywords", "fields"]
_OPEN = ["first", "last", "part", "edits", "seq", "pick", "keywords", "full", "fields"]
_STATE_ROWS = 10_000  # of one value of a list state
BUCKETS = 4096


def keep_rows(state, rows: list) -> None:
    """Put rows into a list state, many in one value as JSON; a value for each row would cost far more than the row's work."""
    if rows:
        state.put([(json.dumps(rows[i:i + _STATE_ROWS]),) for i in range(0, len(rows), _STATE_ROWS)])
    else:
        state.clear()


def kept_rows(state) -> list:
    return [row for (text,) in state.get() for row in json.loads(text)] if state.exists() else []


def wake_at(handle: StatefulProcessorHandle, wake_us: int | None, watermark_ms: int) -> None:
    """One timer just after ``wake_us``, in place of those that there are."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if wake_us is not None:
        handle.registerTimer(max(wake_us // 1000 + 1, watermark_ms + 1))


class WriteProcessor(StatefulProcessor):
    """Edits of the paths and slots of one bucket: those the watermark has not passed, the open writes, and a timer for the next of them."""

    columns = ["path", "slot", "pick", "keywords", "fields", "sets_fields", "edits", "last_seq", "write_us"]

    def __init__(self, gap_us: int, span_us: int):
        self.gap, self.span = gap_us, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROWS)
        self.open = handle.getListState("open", _ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text = lambda column: [x if isinstance(x, str) else None for x in column]
        new: list[list] = []
        for b in rows:
            columns = [b[c].tolist() if c in ("us", "seq", "full") else text(b[c]) for c in _EDIT]
            new += map(list, zip(*columns, strict=True))
        yield self._advance(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, new: list[list], watermark_ms: int) -> pd.DataFrame:
        safe = watermark_ms * 1000
        edits = kept_rows(self.waiting) + new
        writes = {(path, slot): dict(zip(_OPEN, values, strict=True)) for path, slot, *values in kept_rows(self.open)}
        done: list[tuple] = []

        def due(now: dict) -> int:
            return min(now["last"] + self.gap, now["first"] + (now["part"] + 1) * self.span)

        def write(key: tuple, now: dict) -> None:
            if now["edits"]:
                done.append((*key, now["pick"], now["keywords"], now["fields"], now["full"] is not None, now["edits"], now["seq"], due(now)))
            now.update(edits=0, seq=None, pick=None, keywords=None, full=None, fields=None)

        for path, slot, us, seq, full, pick, keywords, fields in sorted((w for w in edits if w[2] < safe), key=lambda w: w[2:4]):
            now = writes.get((path, slot))
            if now is None or us - now["last"] > self.gap:
                if now:
                    write((path, slot), now)
                now = writes[path, slot] = dict.fromkeys(_OPEN) | {"first": us, "last": us, "part": 0, "edits": 0}
            part = (us - now["first"]) // self.span
            if part != now["part"]:
                write((path, slot), now)
            now["last"], now["part"], now["edits"] = us, part, now["edits"] + 1
            if now["seq"] is None or seq > now["seq"]:
                now["seq"], now["pick"], now["keywords"] = seq, pick, keywords
            if full and (now["full"] is None or seq > now["full"]):
                now["full"], now["fields"] = seq, fields
        for key, now in list(writes.items()):
            if now["first"] + (now["part"] + 1) * self.span <= safe:
                write(key, now)
            if now["last"] + self.gap < safe:
                write(key, now)
                del writes[key]
        waiting = [w for w in edits if w[2] >= safe]
        keep_rows(self.waiting, waiting)
        keep_rows(self.open, [[*key, *now.values()] for key, now in writes.items()])
        wake = [w[2] for w in waiting] + [due(now) if now["edits"] else now["last"] + self.gap for now in writes.values()]
        wake_at(self.handle, min(wake, default=None), watermark_ms)
        return pd.DataFrame(done, columns=self.columns)


def spanned_writes(rows: DataFrame, gap_ms: int, max_span_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """The streaming form of ``coalesce_edits`` with a longest span; edits without a path are left out. State lives in RocksDB, which this sets for the session.

    Paths and slots share ``buckets`` states by a hash, since a call of Python and its reads of state cost some milliseconds however few edits
    there are. A task holds one bucket's open writes and unpassed edits at once; a stream keeps its number of buckets.
    """
    ship_package(rows.sparkSession)
    rows.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    kinds = {c: rows.schema[c].dataType for c in ("path", "keywords", "fields")}
    flat = rows.where("path IS NOT NULL").select(
        F.pmod(F.xxhash64("path", "slot"), F.lit(buckets)).alias("bucket"), F.col("path").cast("string").alias("path"), "slot", "ts", F.unix_micros("ts").alias("us"),
        F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), F.coalesce(F.expr(_FULL), F.lit(False)).alias("full"), "pick",
        F.to_json("keywords").alias("keywords"), F.to_json("fields").alias("fields"))
    out = flat.where("us IS NOT NULL").groupBy("bucket").transformWithStateInPandas(
        WriteProcessor(gap_ms * 1000, max_span_ms * 1000), "path string, slot string, pick string, keywords string, fields string, "
        "sets_fields boolean, edits long, last_seq long, write_us long", "append", "eventTime")
    return out.select(F.col("path").cast(kinds["path"]).alias("path"), "slot", "pick", F.from_json("keywords", kinds["keywords"]).alias("keywords"),
                      F.from_json("fields", kinds["fields"]).alias("fields"), "sets_fields", "edits", "last_seq", F.timestamp_micros("write_us").alias("write_at"))


# -- the fold into current state --------------------------------------------------

_PARTS = ("pick", "keywords", "fields")


def fold_edits(edits: DataFrame) -> DataFrame:
    """Newest value per path and part, each as (seq, value); combines before the shuffle."""
    applies = {"pick": _MARK, "keywords": f"not ({_MARK})", "fields": _FULL}
    return edits.groupBy("path").agg(*[
        F.max_by(F.struct(F.col("seq"), F.col(p).alias("value")), F.when(F.expr(cond), F.col("seq"))).alias(p)
        for p, cond in applies.items()
    ])


def merge_states(states: DataFrame) -> DataFrame:
    """Fold a union of folded states; a late read never undoes a newer edit."""
    return states.groupBy("path").agg(*[F.max_by(p, f"{p}.seq").alias(p) for p in _PARTS])


def current_state(state: DataFrame) -> DataFrame:
    """path, pick, keywords, fields, with the defaults of a path without edits."""
    return state.select(
        "path", F.coalesce("pick.value", F.lit("Unmarked")).alias("pick"),
        F.col("keywords.value").alias("keywords"), F.col("fields.value").alias("fields"))
