"""Jobs with side effects on files. Each returns one result row per input row.

Every file is written under a unique temporary name beside its target, flushed
to disk (some hundred together) and moved, so a task that runs twice leaves the same file and a lost
executor leaves no half of one. Paths are local ones on a file system that all executors
mount, or have a scheme; a row whose scheme no executor can open fails by itself, as
does any other bad row. Always drain the result with an action, and do not count on laziness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.sources.jobs import per_file
from sievelight.sources.places import open_read, reason_of, size_of, write_each

CHUNK = 1 << 20


def _put(text: str | bytes | None, f) -> None:
    if text is None:
        raise ValueError("there is no text to write")
    f.write(text.encode() if isinstance(text, str) else bytes(text))


def write_sidecar_files(df: DataFrame, path: str = "path", xml: str = "xml", tasks: int | None = None, held: bool = False) -> DataFrame:
    """One file per row, of text or bytes, under its exact name: path, ok, reason. ``held`` rows are written where they lie, as they are dealt already."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = ((target, partial(_put, text), None) for target, text in zip(batch["path"], batch["xml"]))
            out = [(target, error is None, error and reason_of(error)) for target, error in zip(batch["path"], write_each(files))]
            yield pd.DataFrame(out, columns=["path", "ok", "reason"])

    rows = df.select(F.col(path).alias("path"), F.col(xml).alias("xml"))
    return per_file(rows, job, "path string, ok boolean, reason string", tasks, held)


def _digest(path: str) -> str:
    seen = hashlib.sha256()
    with open_read(path) as f:
        while chunk := f.read(CHUNK):
            seen.update(chunk)
    return seen.hexdigest()


class _Copy:
    """One copy for ``write_each``: hashed on the way, then what the disk holds is read back and compared."""

    def __init__(self, source: str):
        self.source, self.seen, self.there = source, hashlib.sha256(), None

    def write(self, f) -> None:
        with open_read(self.source) as src:
            while chunk := src.read(CHUNK):
                self.seen.update(chunk)
                f.write(chunk)

    def check(self, part: str) -> None:
        self.there = _digest(part)
        if self.there != self.seen.hexdigest():
            raise OSError("the copy reads back with another hash")


def _copy_each(pairs: list[tuple[str, str]]) -> list[tuple[Exception | None, tuple[str, str] | None]]:
    """For each (source, target) what failed, or the hashes of both sides."""
    copies = [_Copy(source) for source, _ in pairs]
    errors = write_each((target, c.write, c.check) for c, (_, target) in zip(copies, pairs))
    return [(error, None if error else (c.seen.hexdigest(), c.there)) for c, error in zip(copies, errors)]


def copy_files(plan: DataFrame, row_id: str = "image_id", tasks: int | None = None) -> DataFrame:
    """Run a copy plan: id, name, action, ok, reason, src_hash, dst_hash.

    ``plan`` needs src_path, dst_folder, name, action and src_sidecar (NULL when
    there is none). A sidecar travels with its image; a failure stays in its row.
    A row that the plan refuses (``refused`` says why) is a failure and touches no file.
    """
    refused = F.col("refused") if "refused" in plan.columns else F.lit(None).cast("string")
    rows = plan.select(F.col(row_id).alias("image_id"), "src_path", "dst_folder", "name", "action", "src_sidecar",
                       refused.alias("refused"))

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            reasons = [row.refused if isinstance(row.refused, str) else None for row in rows]
            hashes = [(None, None)] * len(rows)
            targets = [None] * len(rows)
            for i, row in enumerate(rows):
                try:
                    targets[i] = f"{row.dst_folder.rstrip('/')}/{row.name}"
                except Exception as e:
                    reasons[i] = reason_of(e)
            moves = [i for i, row in enumerate(rows) if reasons[i] is None and row.action in ("Copy", "CopyRenamed")]
            for i, (error, both) in zip(moves, _copy_each([(rows[i].src_path, targets[i]) for i in moves])):
                hashes[i], reasons[i] = both or (None, None), error and reason_of(error)
            # A sidecar goes only where its image has gone.
            cars = [i for i, row in enumerate(rows) if reasons[i] is None and row.action != "Skip" and isinstance(row.src_sidecar, str)]
            for i, (error, _) in zip(cars, _copy_each([(rows[i].src_sidecar, targets[i] + ".xmp") for i in cars])):
                reasons[i] = error and reason_of(error)
            out = [(row.image_id, row.name, row.action, reason is None, reason, *both) for row, reason, both in zip(rows, reasons, hashes)]
            yield pd.DataFrame(
                out, columns=["image_id", "name", "action", "ok", "reason", "src_hash", "dst_hash"])

    kind = plan.schema[row_id].dataType.simpleString()
    return per_file(rows, job, f"image_id {kind}, name string, action string, ok boolean, reason string, "
                               "src_hash string, dst_hash string", tasks)


def hash_files(df: DataFrame, path: str = "path", tasks: int | None = None) -> DataFrame:
    """path, size, hash, error: the input of ``verify_copies`` for each side."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                try:
                    out.append((p, size_of(p), _digest(p), None))
                except Exception as e:
                    out.append((p, None, None, reason_of(e)))
            yield pd.DataFrame(out, columns=["path", "size", "hash", "error"], dtype=object)

    rows = df.select(F.col(path).alias("path"))
    return per_file(rows, job, "path string, size long, hash string, error string", tasks)
