"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PICKS = ("Unmarked", "Picked", "Rejected")
IPTC_FIELDS = ("title", "description", "creator", "rights", "headline", "city", "country",
               "credit", "source", "job_id", "location")

FRAMES = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
])

CAPTURE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("make", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("serial", T.StringType()),
    T.StructField("capture_time", T.StringType()),
    T.StructField("subsec", T.StringType()),
    T.StructField("sequence_number", T.LongType()),
    T.StructField("orientation", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

IPTC = T.StructType([T.StructField(f, T.StringType()) for f in IPTC_FIELDS])

EDITS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("pick", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("fields", IPTC),
])

# One cache layout per version; rows of another version count as absent.
CACHE_VERSION = 3
CACHE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("capture", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("last_used", T.LongType()),
    T.StructField("schema_version", T.IntegerType()),
])
