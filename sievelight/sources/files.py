"""List image files as a ``frames`` table; file contents are never read."""

from __future__ import annotations

import json
import os
import re
import stat
import time
from collections.abc import Iterator, Sequence
from itertools import islice
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sievelight.functions.text import ascii_lower, file_name, name_extension, name_stem, parent_folder
from sievelight.sources.jobs import per_file, ship_package
from sievelight.sources.places import is_part, open_read, place_of, reason_of

# The usual camera RAW extensions and the two JPEG ones. Pass
# your own list to change what counts.
RAW_EXTENSIONS = ("3fr", "ari", "arw", "cr2", "cr3", "crm", "crw", "dcr", "dcs", "dng", "erf", "fff", "iiq", "kdc",
                  "mef", "mos", "mrw", "nef", "nrw", "orf", "ori", "pef", "qtk", "raf", "raw", "rw2", "rwl", "srw",
                  "x3f")
JPEG_EXTENSIONS = ("jpg", "jpeg")
SHARES = 8  # tasks that list one folder
SETTLE_S = 0.05
QUIET_S = 5.0
READ_BYTES, READ_ROWS = 4 << 20, 1000  # read before they are handed on


def frame_columns(path: Column) -> dict[str, Column]:
    return {"session_id": parent_folder(path), "file_name": file_name(path)}


_LISTING = "folder string, path string, size long, mtime_us long, reason string"


class FolderSource(DataSource):
    """``spark.read.format("sievelight_folders")``: options ``folders`` (a JSON list) and ``shares``.

    A partition is a folder and a share of its names, by a hash of the name: every task walks the names, which is cheap, and asks for the
    size and time of its own, which is not. So one huge folder is the work of many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "sievelight_folders"

    def schema(self) -> str:
        return _LISTING

    def reader(self, schema) -> FolderReader:
        return FolderReader(json.loads(self.options["folders"]), int(self.options.get("shares", SHARES)))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(json.loads(self.options["folders"]), int(self.options.get("shares", SHARES)))


class FolderShare(InputPartition):
    def __init__(self, folder: str, share: int, shares: int, changed: tuple[int, int] | None = None):
        self.folder, self.share, self.shares, self.changed = folder, share, shares, changed


class FolderReader(DataSourceReader):
    def __init__(self, folders: list[str], shares: int):
        self.folders, self.shares = folders, shares

    def partitions(self) -> list[FolderShare]:
        return [FolderShare(f, i, self.shares) for f in self.folders for i in range(self.shares)]

    def read(self, partition: FolderShare) -> Iterator[tuple]:
        for entry in _entries(partition.folder, partition.share, partition.shares):
            yield (partition.folder, *entry)


class FolderStream(DataSourceStreamReader):
    """The same as a stream: each micro-batch lists the files that came or changed since the last one, by shares of the names.

    An offset is a time. What is in a batch is told by the inode's time of change, which a move into the folder sets too, so the driver
    keeps no list of names, and a batch that runs again has the same files (or gives one to a later batch, if it changed since). While a folder is
    quiet no offset is new; a file that is written in place for longer than ``QUIET_S`` comes with the next file. An executor's clock may differ; the
    driver's must not run ahead of the file system's by more than ``SETTLE_S``.
    """

    def __init__(self, folders: list[str], shares: int):
        self.folders, self.shares, self.last = folders, shares, None

    def initialOffset(self) -> dict:
        return {"before": 0}

    def latestOffset(self) -> dict:
        now = time.time_ns() // 1000
        if self.last is None or any(self._moved(f, self.last - int(QUIET_S * 1e6)) for f in self.folders):
            time.sleep(SETTLE_S)  # what has a time before ``now`` can be seen from here on
            self.last = now
        return {"before": self.last}

    @staticmethod
    def _moved(folder: str, since_us: int) -> bool:
        store, root = place_of(folder)
        return store.type_name != "local" or os.stat(root).st_mtime_ns // 1000 >= since_us

    def partitions(self, start: dict, end: dict) -> list[FolderShare]:
        return [FolderShare(f, i, self.shares, (start["before"], end["before"])) for f in self.folders for i in range(self.shares)]

    def read(self, partition: FolderShare) -> Iterator[tuple]:
        for path, *facts, reason in _entries(partition.folder, partition.share, partition.shares, partition.changed):
            if path is None:
                raise OSError(reason)
            name = path.rsplit("/", 1)[-1]
            # An entry that cannot be read yet comes once it can; files under a temporary name are not there yet.
            if reason is None and not name.startswith(".") and not is_part(name):
                yield partition.folder, path, *facts, None


def stream_files(spark: SparkSession, paths: str | list[str], shares: int = SHARES) -> DataFrame:
    """The stream of ``scan_files``; a file that changes comes again."""
    ship_package(spark)
    spark.dataSource.register(FolderSource)
    folders = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return _as_frames(spark.readStream.format(FolderSource.name()).option("folders", folders).option("shares", str(shares)).load())


def glob_pattern(glob: str) -> str:
    """A Hadoop glob over names as a regular expression for ``rlike``: ``*``, ``?``, ``[a-c]``, ``[^x]``, ``{a,b}``, and a backslash before any of them."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1:end]
            out.append("[" + ("^" if inside[0] in "!^" else "") + inside.lstrip("!^").replace("[", "\\[") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        else:
            out.append("|" if c == "," and depth else re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}\\z"


def scan_files(spark: SparkSession, paths: str | list[str], shares: int = SHARES) -> DataFrame:
    """One row per file directly inside each folder; the folder is the session. ``shares`` tasks list one folder."""
    ship_package(spark)
    spark.dataSource.register(FolderSource)
    folders = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return _as_frames(spark.read.format(FolderSource.name()).option("folders", folders).option("shares", str(shares)).load())


def list_folders(folders: DataFrame, folder: str = "folder", tasks: int | None = None, shares: int = 1) -> DataFrame:
    """List a table of folders, spread over the cluster by folder and, with ``shares``, by parts of each folder's names.

    Names, sizes and times only; Spark's own file reader leaves empty files out.
    An entry that cannot be read is a Failed row, and so is a folder (without a
    path). Folders, sockets and the like are skipped, links are followed.
    """
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["folder", "path", "size", "mtime_us", "reason"]
        for batch in batches:
            for home, share in zip(batch["folder"], batch["share"], strict=True):
                entries = _entries(home, share, shares)
                while rows := [(home, *e) for e in islice(entries, 10_000)]:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    parts = folders.select(F.col(folder).alias("folder"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    return _as_frames(per_file(parts, job, _LISTING, tasks))


def _as_frames(rows: DataFrame) -> DataFrame:
    failed = F.col("reason").isNotNull()
    return rows.select(
        F.coalesce(frame_columns(F.col("path"))["session_id"], F.col("folder")).alias("session_id"), "path",
        frame_columns(F.col("path"))["file_name"].alias("file_name"), F.when(failed, 0).otherwise(F.col("size")).alias("size"),
        F.timestamp_micros("mtime_us").alias("mtime"), F.when(failed, "Failed").otherwise("Placeholder").alias("status"), "reason")


def _entries(home: str, share: int = 0, shares: int = 1, changed: tuple[int, int] | None = None) -> Iterator[tuple]:
    """(path, size, mtime in microseconds, reason) of each file of one share of a folder; whatever fails is a row.

    The first share tells of a folder that cannot be listed. A store that is no local file system tells sizes with the names, so
    there the first share has all. With ``changed`` only files whose inode (elsewhere: content) changed in that span of microseconds.
    """
    within = lambda us: changed is None or us is not None and changed[0] <= us < changed[1]
    try:
        store, root = place_of(home)
        if store.type_name != "local":
            for info in store.get_file_info(FileSelector(root)) if share == 0 else ():
                if info.type == FileType.File:
                    when = info.mtime_ns // 1000 if info.mtime_ns is not None else None
                    if not within(when):
                        continue
                    yield f"{home.rstrip('/')}/{info.base_name}", info.size, when, None
            return
        with os.scandir(root) as found:
            for entry in found:
                if shares > 1 and crc32(os.fsencode(entry.name)) % shares != share:
                    continue
                path = entry.path.encode(errors="replace").decode()
                try:
                    facts = entry.stat()
                    if stat.S_ISREG(facts.st_mode) and within(facts.st_ctime_ns // 1000):
                        yield path, facts.st_size, facts.st_mtime_ns // 1000, None
                except OSError as e:
                    yield path, None, None, f"entry not read: {e.strerror}"
    except Exception as e:
        if share and os.path.isdir(home.removeprefix("file://").removeprefix("file:")):
            raise  # the first share may have read it; Spark tries this one again
        if not share:
            yield None, None, None, f"folder not listed: {getattr(e, 'strerror', None) or reason_of(e)}"


def read_files(files: DataFrame, path: str = "path", tasks: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """path, the columns ``keep``, content, error: whole small files, handed on some MB at a time; an empty file has empty content.

    Columns that are needed beside the content go through the job: Spark takes the job's result for about as small as the paths are,
    and a join to it may broadcast the content of all files.
    """
    rows = files.select(F.col(path).cast("string").alias("path"), *keep)
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors, size, start = [], [], 0, 0
            for i, p in enumerate(batch.column(0).to_pylist()):
                content = error = None
                try:
                    with open_read(p) as f:
                        content = f.read()
                    size += len(content)
                except Exception as e:
                    error = f"not read: {reason_of(e)}"
                contents.append(content), errors.append(error)
                if size >= READ_BYTES or len(contents) >= READ_ROWS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(start, len(contents)).columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())],
                        [*batch.schema.names, "content", "error"])
                    contents, errors, size, start = [], [], 0, i + 1

    return per_file(rows, job, schema, tasks, arrow=True)


def _kind(name: Column, extensions) -> Column:
    return ascii_lower(name_extension(name)).isin(*[e.lower() for e in extensions])


def keep_image_extensions(df: DataFrame, raw=RAW_EXTENSIONS, jpeg=JPEG_EXTENSIONS, name: str = "file_name") -> DataFrame:
    return df.where(_kind(F.col(name), [*raw, *jpeg]))


def hide_paired(df: DataFrame, session: list[str] = ("session_id",), name: str = "file_name",
                raw=RAW_EXTENSIONS, jpeg=JPEG_EXTENSIONS, readable: Column | None = None) -> DataFrame:
    """Drop a JPEG whose session holds a readable RAW of the same stem (A-Z folded).

    Without ``readable``, a RAW counts unless its ``status`` column says Failed.
    """
    if readable is None and "status" in df.columns:
        readable = F.col("status") != "Failed"
    rows = df.withColumns({"_stem": ascii_lower(name_stem(F.col(name))), "_jpeg": _kind(F.col(name), jpeg)})
    raws = rows.where(_kind(F.col(name), raw))
    if readable is not None:
        raws = raws.where(readable)
    pairs = raws.select(*session, "_stem", F.lit(True).alias("_jpeg")).distinct()
    return rows.join(pairs, [*session, "_stem", "_jpeg"], "left_anti").select(*df.columns)


def split_failed(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(good, failed); together they are the input."""
    failed = F.coalesce(F.col(status) == "Failed", F.lit(False))
    return df.where(~failed), df.where(failed)


def load_status(df: DataFrame, error: str = "error") -> DataFrame:
    """Status and reason of a row that has been read: one bad file stays one row."""
    return df.withColumns({
        "status": F.when(F.col(error).isNull(), "Loaded").otherwise("Failed"), "reason": F.col(error)
    })
