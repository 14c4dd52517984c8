"""Burst queries over ``events``: sessions are days, cameras are ``user_id % 5``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions.capture import is_joinable
from sievelight.operators import bursts as B
from sievelight.operators.views import view_positions
from sievelight.plans.registry import EVENT_FRAMES, event_frames, query

# Events of one camera are about 21 minutes apart, so gaps are scaled up:
# a "second" is 20 minutes, the gap for precise times 10 minutes.
GAP_US, SECOND_US = 600_000_000, 1_200_000_000
ORDER = ["time_us", "image_id"]

BURSTS = EVENT_FRAMES + f""",
  p AS (SELECT *, time_us IS NOT NULL AND coalesce(seq, -1) <> 0 AS j,
               time_us IS NOT NULL AND coalesce(seq, 0) >= 1 AS q FROM frames),
  l AS (SELECT *, lag(time_us) OVER w AS pt, lag(has_subsec) OVER w AS ps, lag(seq) OVER w AS pq0,
               lag(j) OVER w AS pj, lag(q) OVER w AS pq
        FROM p WINDOW w AS (PARTITION BY session_id, camera ORDER BY time_us, image_id)),
  b AS (SELECT *, CASE WHEN j AND pj AND abs(time_us - pt) <= CASE WHEN has_subsec AND ps THEN {GAP_US} ELSE {SECOND_US} END
                  AND CASE WHEN q AND pq THEN seq > pq0 ELSE q = pq END THEN 0 ELSE 1 END AS brk FROM l),
  r AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY session_id, camera ORDER BY time_us, image_id) AS BIGINT) AS run FROM b),
  s AS (SELECT *, count(*) OVER (PARTITION BY session_id, camera, run) AS n,
               row_number() OVER (PARTITION BY session_id, camera, run ORDER BY time_us, image_id) AS pos FROM r),
  g AS (SELECT *, CASE WHEN n >= CASE WHEN q THEN 2 ELSE 3 END THEN run END AS burst_id,
               CASE WHEN n >= CASE WHEN q THEN 2 ELSE 3 END THEN pos END AS burst_pos,
               CASE WHEN n >= CASE WHEN q THEN 2 ELSE 3 END THEN n END AS burst_size FROM s)"""


def grouped_events(spark, sf):
    return B.group_bursts(event_frames(spark, sf), ["session_id"], ORDER, time="time_us",
                          max_gap=GAP_US, second=SECOND_US)


@query("is_joinable", f"WITH {EVENT_FRAMES} SELECT image_id, coalesce(seq, -1) <> 0 AS joinable FROM frames")
def joinable(spark, sf):
    return event_frames(spark, sf).select(
        "image_id", is_joinable(F.col("time_us"), F.col("seq")).alias("joinable"))


@query("group_bursts", f"WITH {BURSTS} SELECT session_id, camera, image_id, burst_id, burst_size FROM g")
def group_bursts(spark, sf):
    return grouped_events(spark, sf).select("session_id", "camera", "image_id", "burst_id", "burst_size")


@query("burst_position", f"WITH {BURSTS} SELECT image_id, burst_pos, burst_size FROM g WHERE burst_id IS NOT NULL")
def burst_position(spark, sf):
    return grouped_events(spark, sf).where("burst_id is not null").select("image_id", "burst_pos", "burst_size")


@query("burst_sizes", f"WITH {BURSTS} SELECT image_id, CASE WHEN burst_pos = 1 THEN burst_size END AS badge FROM g")
def burst_sizes(spark, sf):
    return B.burst_sizes(grouped_events(spark, sf)).select("image_id", "badge")


@query("dense_burst_index", f"""WITH {BURSTS},
  f AS (SELECT session_id, camera, burst_id, row_number() OVER (PARTITION BY session_id ORDER BY time_us, image_id) AS burst_index,
           CAST('0x' || substr(md5(file_name), 1, 15) AS BIGINT) AS burst_key FROM g WHERE burst_pos = 1)
SELECT g.session_id, g.image_id, f.burst_index, f.burst_key FROM g LEFT JOIN f
  ON f.session_id = g.session_id AND f.camera = g.camera AND f.burst_id = g.burst_id""")
def dense_burst_index(spark, sf):
    rows = B.dense_burst_index(grouped_events(spark, sf), ["session_id"], ORDER, "image_id", first_name="file_name")
    return rows.select("session_id", "image_id", "burst_index", "burst_key")


@query("burst_boundaries", f"""WITH {BURSTS},
  k AS (SELECT session_id, image_id, CAST(camera AS VARCHAR) || '/' || CAST(burst_id AS VARCHAR) AS grp,
               row_number() OVER (PARTITION BY session_id ORDER BY time_us, image_id) AS pos,
               count(*) OVER (PARTITION BY session_id) AS n FROM g),
  m AS (SELECT *, lag(grp) OVER (PARTITION BY session_id ORDER BY pos) AS pg,
               CASE WHEN grp IS NOT NULL THEN min(pos) OVER (PARTITION BY session_id, grp) END AS head FROM k),
  i AS (SELECT *, lag(head) OVER (PARTITION BY session_id ORDER BY pos) AS ph,
               min(CASE WHEN grp IS NULL OR pg IS NULL OR pg <> grp THEN pos END) OVER
                 (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS jump FROM m)
SELECT session_id, image_id, pos AS position, coalesce(jump, n) AS next_boundary,
       CASE WHEN head < pos THEN head WHEN pos = 1 THEN 1 ELSE coalesce(ph, pos - 1) END AS prev_boundary FROM i""")
def burst_boundaries(spark, sf):
    rows = grouped_events(spark, sf).withColumn(
        "grp", F.concat(F.col("camera").cast("string"), F.lit("/"), F.col("burst_id").cast("string")))
    out = B.burst_boundaries(rows, ["session_id"], ORDER, "grp", "image_id")
    return out.select("session_id", "image_id", "position", "next_boundary", "prev_boundary")


@query("frame_meta", f"""WITH {EVENT_FRAMES}
SELECT image_id, epoch_ms(strptime(capture_time, '%Y:%m:%d %H:%M:%S')) +
  CASE WHEN has_subsec THEN seq_ms ELSE 0 END AS time_ms, has_subsec,
  coalesce(CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END, CAST(camera AS VARCHAR)) AS camera, seq
FROM (SELECT *, (user_id % 10) * 100 AS seq_ms FROM frames)""")
def frame_meta(spark, sf):
    rows = event_frames(spark, sf).select(
        "image_id", "capture_time", F.when(F.col("has_subsec"), (F.col("user_id") % 10).cast("string")).alias("subsec"),
        F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("serial"),
        F.col("camera").cast("string").alias("model"), F.col("seq").alias("sequence_number"))
    return B.frame_meta(rows).select("image_id", "time_ms", "has_subsec", "camera", "seq")


@query("burst_days", f"""WITH {BURSTS}
SELECT session_id, camera, count(*) AS frames, count(*) FILTER (WHERE burst_pos = 1) AS bursts,
  count(burst_id) AS frames_in_bursts, max(burst_size) AS longest,
  count(*) FILTER (WHERE pick = 'Picked') / count(*) AS share_picked
FROM g GROUP BY session_id, camera""")
def burst_days(spark, sf):
    """Per day and camera: bursts, frames in bursts, longest burst, share picked."""
    return grouped_events(spark, sf).groupBy("session_id", "camera").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("burst_pos") == 1).alias("bursts"),
        F.count("burst_id").alias("frames_in_bursts"), F.max("burst_size").alias("longest"),
        (F.count_if(F.col("pick") == "Picked") / F.count(F.lit(1))).alias("share_picked"))
