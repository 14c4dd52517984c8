"""Live inputs: watched folders, coalesced requests, bursts on a capture stream, the flush barrier."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievelight.functions.text import canonical_path
from sievelight.sources.files import frame_columns, glob_pattern, stream_files
from sievelight.sources.jobs import ship_package
from sievelight.streaming.edits import ROCKSDB, STATE_STORE, coalesce_edits, keep_rows, kept_rows, wake_at

_FILES = "path string, modificationTime timestamp, length long, content binary"
_FRAME_COLUMNS = ["session_id", "path", "file_name", "size", "mtime", "status", "reason"]


def watch_folder(spark: SparkSession, path: str, glob: str | None = None, per_batch: int | None = None) -> DataFrame:
    """Stream of ``frames`` for files that appear in a folder, each path once. Deletions are not reported.

    Tasks list shares of the names, and what has been reported is state of the stream, in RocksDB (set for the session), so the driver holds no
    names. With ``per_batch`` Spark's own file stream cuts the batches; its driver keeps the list of all files, and it leaves out empty ones.
    """
    if per_batch:
        reader = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", per_batch)
        found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(
            canonical_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        return found.withColumns({
            **frame_columns(F.col("path")), "status": F.lit("Placeholder"), "reason": F.lit(None).cast("string"),
        }).select(*_FRAME_COLUMNS)
    spark.conf.set(STATE_STORE, ROCKSDB)
    found = stream_files(spark, path)
    if glob:
        found = found.where(F.col("file_name").rlike(glob_pattern(glob)))
    return found.select(*_FRAME_COLUMNS).dropDuplicates(["path"])


def dedupe_requests(requests: DataFrame, keys: list[str], time: str = "ts", horizon: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Requests for the same thing coalesce until none has come for ``horizon``: the first row of each such run stays.

    A stream and a batch run one plan and give the same rows. The stream's state is the open run of each thing, whose
    first row comes out when the watermark (``horizon`` behind, or ``watermark``) passes the run's end; rows later than that are dropped.
    """
    rows = requests.withWatermark(time, watermark or horizon) if requests.isStreaming else requests
    spaced = rows.groupBy(*keys, F.session_window(time, horizon).alias("_w"))
    return spaced.agg(F.min_by(F.struct(*requests.columns), time).alias("_r")).select("_r.*")


def flush_barrier(query: StreamingQuery, log: DataFrame, written: DataFrame, gap_ms: int = 700) -> DataFrame:
    """Writes that are still open once the stream has taken in everything.

    A session window keeps the last pause of each path open, and a drained
    stream does not close it. Folding the log in batch finds those writes; they
    have to be written before a copy is planned.
    """
    query.processAllAvailable()
    return coalesce_edits(log, gap_ms).join(written.select("path", "slot", "last_seq"), ["path", "slot", "last_seq"], "left_anti")


def burst_windows(frames: DataFrame, keys: list[str], time: str = "ts", gap_us: int = 600_000, min_run: int = 3,
                  watermark: str = "10 minutes") -> DataFrame:
    """Bursts of cameras without sequence numbers, for a stream or a batch.

    A row exactly one gap after the last still joins Spark's session window,
    which is the burst rule's "gap <= limit".
    """
    rows = frames.withWatermark(time, watermark) if frames.isStreaming else frames
    runs = rows.groupBy(*keys, F.session_window(time, f"{gap_us} microseconds").alias("_w")).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("burst_size"))
    return runs.where(F.col("burst_size") >= min_run).drop("_w")


_NO_KEY = "\u2400"  # stands for a null key, with which state of other keys would be lost
_ROWS = T.StructType([T.StructField("rows", T.StringType())])
_RUN = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("fine", T.BooleanType()),
                     T.StructField("seq", T.LongType()), T.StructField("size", T.LongType())])


class BurstProcessor(StatefulProcessor):
    """Frames of one camera: a list state of those the watermark has not passed, a value state of the open run, and a timer for the next of them."""

    def __init__(self, keys: list[str], gap_us: int, second_us: int, min_run: int):
        self.keys, self.gap, self.wide, self.min_run = keys, gap_us, max(gap_us, second_us), min_run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROWS)
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[list] = []
        for b in rows:
            seq = [None if s != s or s is None else int(s) for s in b["seq"].tolist()]
            new += map(list, zip(b["us"].tolist(), b["tie"].tolist(), b["fine"].tolist(), seq, strict=True))
        yield self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, new: list[list], watermark_ms: int) -> pd.DataFrame:
        """Read the frames behind the watermark in time order and close the runs that can grow no more."""
        safe = watermark_ms * 1000
        frames = kept_rows(self.waiting) + new
        first, last, fine, number, size = self.run.get() if self.run.exists() else (None, None, None, None, 0)
        done: list[tuple] = []

        def finish() -> None:
            if size >= (2 if (number or 0) >= 1 else self.min_run):
                done.append((*key, first, last, size))

        for us, _, is_fine, n in sorted((w for w in frames if w[0] < safe), key=lambda w: w[:2]):
            both = (n or 0) >= 1, (number or 0) >= 1
            limit = self.gap if is_fine and fine else self.wide
            joins = size and n != 0 and number != 0 and us - last <= limit and (n > number if all(both) else both[0] == both[1])
            if not joins:
                finish()
                first, size = us, 0
            last, fine, number, size = us, is_fine, n, size + 1
        if size and last + self.wide < safe:
            finish()
            size = 0
        waiting = [w for w in frames if w[0] >= safe]
        self._keep(waiting, (first, last, fine, number, size) if size else None, watermark_ms)
        return pd.DataFrame(done, columns=[*self.keys, "first_us", "last_us", "burst_size"])

    def _keep(self, waiting: list[tuple], run: tuple | None, watermark_ms: int) -> None:
        keep_rows(self.waiting, waiting)
        if run:
            self.run.update(run)
        else:
            self.run.clear()
        wake = [w[0] for w in waiting] + ([run[1] + self.wide] if run else [])
        wake_at(self.handle, min(wake, default=None), watermark_ms)


def stream_bursts(frames: DataFrame, camera: str = "camera", time: str = "ts", has_subsec: str = "has_subsec", seq: str = "seq",
                  session: list[str] = (), tie: str | None = None, max_gap_ms: int = 600, second_ms: int = 1000, min_run: int = 3,
                  watermark: str = "10 seconds") -> DataFrame:
    """Bursts with sequence numbers on a live stream: session columns, camera, first_us, last_us, burst_size.

    A run that crosses two sessions is two; frames of one instant go by ``tie``. Per session and camera the state is the open run and
    the frames the watermark has not passed, which are read in time order once it has. One camera takes some
    tens of frames a second, so a key's work is bounded by the hardware. The state lives in RocksDB, which this sets for the session.
    """
    ship_package(frames.sparkSession)
    frames.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    keys = [*session, "camera"]
    rows = frames.withWatermark(time, watermark).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(_NO_KEY)).alias(k) for c, k in zip([*session, camera], keys, strict=True)],
        F.col(time).alias(time), F.unix_micros(time).alias("us"), (F.coalesce(F.col(tie).cast("long"), F.lit(0)) if tie else F.lit(0)).cast("long").alias("tie"), F.coalesce(F.col(has_subsec), F.lit(False)).alias("fine"),
        F.col(seq).cast("bigint").alias("seq"))
    found = rows.groupBy(*keys).transformWithStateInPandas(
        BurstProcessor(keys, max_gap_ms * 1000, second_ms * 1000, min_run),
        ", ".join(f"{k} string" for k in keys) + ", first_us long, last_us long, burst_size long", "append", "eventTime")
    return found.withColumns({k: F.nullif(F.col(k), F.lit(_NO_KEY)) for k in keys})
