"""Jobs that read a few KB of each file: capture metadata, preview lists, JPEG audits.

Each job is one ``mapInPandas`` hop over a table of paths. Spread many files of
one folder with ``tasks``; the rows hold only paths, so that shuffle is small.
``content`` names a binary column instead, for tables that carry file bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.capture import burst_seq, sequence_fields, valid_orientation
from sievelight.functions.text import ascii_lower, name_extension, normalize_make
from sievelight.operators.previews import flag_implausible
from sievelight.sources.jobs import per_file
from sievelight.sources.places import reason_of
from sievelight.sources.ranged import Ranged, exif_facts, jpeg_claims, jpeg_complete, jpeg_exif


def _per_file(df: DataFrame, columns: list[str], content: str | None, schema: str,
              read: Callable[[Ranged, dict], Iterator[dict]], tasks: int | None) -> DataFrame:
    """Run ``read`` on every row; an unreadable file becomes a row with ``error``."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = df.select(*columns, *([content] if content else []))

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                src = None
                try:
                    src = Ranged(row["path"], row[content] if content else None)
                    out.extend({**row, **r} for r in read(src, row))
                except Exception as e:
                    out.append({**row, "error": f"not read: {getattr(e, 'strerror', None) or reason_of(e)}"})
                finally:
                    if src:
                        src.close()
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names, dtype=object)

    return per_file(rows, job, schema, tasks, held=content is not None)


def _is_jpeg(path: Column) -> Column:
    return ascii_lower(name_extension(path)).isin("jpg", "jpeg")


def extract_capture_metadata(frames: DataFrame, content: str | None = None, tasks: int | None = None) -> DataFrame:
    """make, model, serial, capture_time, subsec, sequence_number, orientation, error per path.

    An absent or damaged field is NULL. A JPEG without EXIF is all NULL and no
    error; a container that is neither TIFF nor JPEG has ``error``.
    """
    def read(src: Ranged, row: dict) -> Iterator[dict]:
        if row["_jpeg"]:
            yield jpeg_exif(src) or {}
            return
        facts = exif_facts(src)
        yield facts if facts is not None else {"error": "neither TIFF nor JPEG data"}

    raw = _per_file(
        frames.withColumn("_jpeg", _is_jpeg(F.col("path"))), ["path", "_jpeg"], content,
        "path string, _jpeg boolean, make string, model string, serial string, capture_time string, subsec string, "
        "sequence_block binary, orientation int, error string", read, tasks)
    raw = raw.withColumn("_fields", sequence_fields(F.col("sequence_block")))
    sequence = F.when(~F.col("_jpeg"), burst_seq(F.col("_fields.release_mode"), F.col("_fields.image_number")))
    return raw.select(
        "path", F.when(F.col("_jpeg"), F.col("make")).otherwise(normalize_make(F.col("make"))).alias("make"),
        "model", "serial", "capture_time", "subsec", sequence.alias("sequence_number"),
        valid_orientation(F.col("orientation")).alias("orientation"), "error")


def index_previews(frames: DataFrame, content: str | None = None, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(previews, errors): the embedded JPEGs of each file that lie inside it.

    The first pointer to an offset stays. Each file's pointers arrive as one
    array, so the checks need no shuffle.
    """
    def read(src: Ranged, row: dict) -> Iterator[dict]:
        yield {"size": src.size, **jpeg_claims(src)}

    claim = ("array<struct<offset:bigint,len:bigint,width:bigint,height:bigint,own_width:bigint,own_height:bigint,"
             "starts:boolean,whole_file:boolean,turn:bigint>>")
    files = _per_file(frames, ["path"], content, f"path string, size long, error string, claims {claim}", read, tasks)
    stated = lambda p: (p["width"] > 0) & (p["height"] > 0)
    side = lambda p, name: F.when(stated(p), p[name]).otherwise(p[f"own_{name}"]).cast("int").alias(name)
    found = F.transform(F.filter("claims", lambda p: p["starts"]), lambda p: F.struct(
        p["offset"].alias("offset"), p["len"].alias("len"), side(p, "width"), side(p, "height"), p["whole_file"].alias("whole_file")))
    sound = F.filter(found, lambda p: (p["len"] > 0) & (p["offset"] + p["len"] <= F.col("size"))
                     & (p["width"] > 0) & (p["height"] > 0))
    turn = F.get(F.filter(F.transform("claims", lambda p: p["turn"]), lambda t: t != 0), F.lit(0)).cast("int")
    files = files.withColumns({"found": sound, "orientation": turn})
    first = F.filter("found", lambda p, i: F.array_position(F.transform("found", lambda q: q["offset"]), p["offset"]) == i + 1)
    previews = files.where("error is null").select(
        "path", valid_orientation(F.col("orientation")).alias("orientation"), F.explode(first).alias("p"))
    errors = files.where("error is not null").select("path", "error")
    return previews.select("path", "p.*", "orientation"), errors


def audit_jpegs(previews: DataFrame, content: str | None = None, tasks: int | None = None) -> DataFrame:
    """Add ``truncated`` (no end marker after the first scan header) and ``implausible``."""
    def read(src: Ranged, row: dict) -> Iterator[dict]:
        yield {"truncated": not jpeg_complete(src, row["offset"], row["len"])}

    columns = ["path", "offset", "len", "width", "height"]
    checked = _per_file(previews, columns, content,
                        "path string, offset long, len long, width int, height int, truncated boolean, error string",
                        read, tasks)
    return flag_implausible(checked)
