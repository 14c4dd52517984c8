"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.templates import pad_number
from sievelight.session import BATCH_BYTES, RECOMMENDED

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Camera time has no zone; every comparison reads it as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Python workers get texts some MB at a time, whatever the number of rows (Spark's own limit is 64 MB).
    spark.conf.set(BATCH_BYTES, RECOMMENDED[BATCH_BYTES])
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def dealt(rows: DataFrame) -> DataFrame:
    """A table of one small file is one partition; rows that get Python work each are dealt over the shuffle partitions first."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as frames: a day is a session, ``user_id % 5`` is a camera."""
    shot = F.col("_shot")
    rows = table(spark, sf_dir, "events").withColumn("_shot", F.get_json_object("props", "$.k").try_cast("int"))
    return rows.select(
        F.col("event_id").alias("image_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
        F.col("ts").alias("mtime"),
        F.unix_micros("ts").alias("time_us"),
        F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("capture_time"),
        F.concat(F.lit("DSC"), pad_number(F.col("event_id"), F.lit(5)), F.lit(".ARW")).alias("file_name"),
        (F.col("user_id") % 5).alias("camera"),
        F.col("user_id"), F.col("event_type"), F.col("value"),
        F.when(F.col("event_type") == "purchase", "Picked").when(F.col("event_type") == "error", "Rejected")
        .otherwise("Unmarked").alias("pick"),
        F.when(shot >= 20, shot).when(shot >= 10, 0).alias("seq"),
        (shot % 3 > 0).alias("has_subsec"),
    )


EVENT_FRAMES = """
  frames AS (
    SELECT event_id AS image_id, strftime(ts, '%Y-%m-%d') AS session_id, epoch_us(ts) AS time_us,
           strftime(ts, '%Y:%m:%d %H:%M:%S') AS capture_time,
           'DSC' || CASE WHEN event_id < 100000 THEN lpad(CAST(event_id AS VARCHAR), 5, '0')
                         ELSE CAST(event_id AS VARCHAR) END || '.ARW' AS file_name,
           user_id % 5 AS camera, user_id, event_type, value,
           CASE event_type WHEN 'purchase' THEN 'Picked' WHEN 'error' THEN 'Rejected' ELSE 'Unmarked' END AS pick,
           CASE WHEN k >= 20 THEN k WHEN k >= 10 THEN 0 END AS seq, k % 3 > 0 AS has_subsec
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""
