"""Open folders: from files on disk to frames with metadata, marks and keywords, through the metadata cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators.bursts import frame_meta
from sievelight.operators.cache import cache_split, read_cache, readable_json, save_cache
from sievelight.operators.selection import attach_sidecars
from sievelight.schema import CAPTURE
from sievelight.session import shared_folder
from sievelight.sources.files import hide_paired, keep_image_extensions, scan_files, split_failed
from sievelight.sources.media import extract_capture_metadata
from sievelight.sources.sidecars import read_sidecars

_FACTS = [f for f in CAPTURE.fields if f.name not in ("path", "error")]
_PAYLOAD = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _FACTS)


def open_folders(spark: SparkSession, paths: str | list[str], cache: str, now: int, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(frames, read): the image files of folders with all that is known of them, and the rows whose bytes had to be read.

    Listing, extension filter and pairing give the frames. A frame whose path, size and time the cache table under
    ``cache`` knows takes its metadata from there; the others are read, once, and stored, also when they cannot be read, so that the next
    call reads nothing that has not changed. Sidecars give marks and keywords. A file that cannot be listed is a
    Failed frame without metadata. ``now`` is the time of use that the cache keeps.
    """
    frames = hide_paired(keep_image_extensions(scan_files(spark, paths))).withColumn("mtime_ns", F.unix_micros("mtime") * 1000)
    listed = shared_folder(spark, "listed")
    frames.write.parquet(listed)  # the folder is listed once
    frames = spark.read.schema(frames.schema).parquet(listed)
    good, failed = split_failed(frames)
    hits, misses = cache_split(good, read_cache(spark, cache), F.col("capture").isNull() | readable_json(F.col("capture"), _PAYLOAD))
    payload = F.when(F.col("error").isNull(), F.to_json(F.struct(*[f.name for f in _FACTS])))
    fresh = extract_capture_metadata(misses).join(misses.select("path", "size", "mtime_ns"), "path").withColumn("capture", payload)
    fresh = fresh.withColumn("payload_bytes", F.coalesce(F.octet_length("capture"), F.lit(0)).cast("bigint"))
    known, stored = shared_folder(spark, "hits"), shared_folder(spark, "read")
    hits.write.parquet(known)  # both come from the table that is replaced below
    fresh.write.parquet(stored)
    hits, fresh = spark.read.schema(hits.schema).parquet(known), spark.read.schema(fresh.schema).parquet(stored)
    save_cache(spark, cache, fresh, hits, now, buckets=buckets)
    facts = F.from_json("capture", _PAYLOAD)
    unreadable = F.when(F.col("capture").isNull(), "could not be read when it was stored").alias("error")
    old = hits.select("path", facts.alias("_facts"), unreadable).select("path", "_facts.*", "error")
    meta = fresh.select("path", *[f.name for f in _FACTS], "error").unionByName(old)
    opened = good.unionByName(failed).join(meta, "path", "left").withColumn(
        "status", F.when((F.col("status") == "Failed") | F.col("error").isNotNull(), "Failed").otherwise("Loaded")).withColumn(
        "reason", F.coalesce("reason", "error")).drop("error")
    cars = read_sidecars(spark, paths).where("error IS NULL").select("path", "pick", "keywords", "iptc")
    return frame_meta(attach_sidecars(opened, cars, ["path"])), fresh
