"""Burst grouping: runs of frames of one camera, cut by gaps and sequence resets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.capture import is_joinable, sort_key, sort_key_ms
from sievelight.operators.lanes import (
    Lanes, join_groups, last_seen, next_seen, position, previous, running, total,
)


def frame_meta(df: DataFrame, capture_time: str = "capture_time", subsec: str = "subsec",
               serial: str = "serial", model: str = "model", sequence: str = "sequence_number") -> DataFrame:
    """Inputs of the burst rule: time_ms, has_subsec, camera, seq."""
    return df.withColumns({
        "time_ms": sort_key_ms(sort_key(F.col(capture_time), F.col(subsec))),
        "has_subsec": F.col(subsec).isNotNull(),
        "camera": F.coalesce(F.col(serial), F.col(model)),
        "seq": F.col(sequence),
    })


def group_bursts(df: DataFrame, session: list[str], order: list[str], camera: str = "camera",
                 time: str = "time_ms", has_subsec: str = "has_subsec", seq: str = "seq",
                 max_gap: int = 600, second: int = 1000, min_run: int = 3) -> DataFrame:
    """Add burst_id (run number within session and camera), burst_pos and burst_size.

    All three are NULL outside a burst. ``order`` is capture order, ending in a
    unique column; ``max_gap`` and ``second`` are in units of ``time``. Position
    and size come from the row numbers of the run's first row and of the next
    run's, so even a run with a third of all rows is never one task's work.
    """
    joinable = is_joinable(F.col(time), F.col(seq))
    numbered = joinable & (F.coalesce(F.col(seq), F.lit(0)) >= 1)
    facts = F.struct(
        F.col(time).alias("time"), F.coalesce(F.col(has_subsec), F.lit(False)).alias("fine"),
        F.col(seq).alias("seq"), joinable.alias("joinable"), numbered.alias("numbered"),
    )
    lane = (
        Lanes(df, [*session, camera], order)
        .with_columns(_now=facts)
        .scan(_past=previous(F.col("_now")), _at=position(), _rows=total())
    )
    now, past = F.col("_now"), F.col("_past")
    limit = F.when(now["fine"] & past["fine"], F.lit(max_gap)).otherwise(F.lit(max(max_gap, second)))
    in_sequence = F.when(now["numbered"] & past["numbered"], now["seq"] > past["seq"]).otherwise(
        now["numbered"] == past["numbered"]
    )
    joins = now["joinable"] & past["joinable"] & (F.abs(now["time"] - past["time"]) <= limit) & in_sequence
    lane = lane.with_columns(_starts=~F.coalesce(joins, F.lit(False)))
    start = F.when(F.col("_starts"), F.col("_at"))
    lane = lane.scan(_run=running(F.col("_starts").cast("int")), _first=last_seen(start), _next=next_seen(start))
    first = F.coalesce(start, F.col("_first"))
    size = F.coalesce(F.col("_next"), F.col("_rows") + 1) - first
    is_burst = size >= F.when(now["numbered"], F.lit(2)).otherwise(F.lit(min_run))
    return lane.with_columns(
        burst_id=F.when(is_burst, F.col("_run").cast("bigint")),
        burst_pos=F.when(is_burst, F.col("_at") - first + 1),
        burst_size=F.when(is_burst, size),
    ).rows("_now", "_past", "_starts", "_at", "_rows", "_run", "_first", "_next")


def burst_sizes(grouped: DataFrame) -> DataFrame:
    """``badge``: the burst's size on its first frame only."""
    return grouped.withColumn("badge", F.when(F.col("burst_pos") == 1, F.col("burst_size")))


def dense_burst_index(grouped: DataFrame, session: list[str], order: list[str], row_id: str,
                      camera: str = "camera", first_name: str | None = None) -> DataFrame:
    """Number the bursts of a session 1, 2, ... by the place of their first frame.

    With ``first_name``, a column that names a frame for good (its path), bursts also get ``burst_key``, a 60-bit hash of that of
    their first frame. It stays when later runs see more bursts, which moves ``burst_index``.
    """
    keys = [*session, camera, "burst_id"]
    named = {"burst_key": F.conv(F.left(F.md5(F.col(first_name).cast("string")), F.lit(15)), 16, 10).cast("bigint")} if first_name else {}
    firsts = grouped.where(F.col("burst_pos") == 1).withColumns(named).select(*dict.fromkeys([*keys, *order, *named]))
    index = Lanes(firsts, session, order).scan(burst_index=position()).rows().select(*keys, "burst_index", *named)
    return join_groups(grouped, index, keys, [row_id], may_lack="burst_id")


def burst_boundaries(df: DataFrame, session: list[str], order: list[str], group: str, row_id: str) -> DataFrame:
    """Jump targets as 1-based view positions.

    ``next_boundary`` is the next row of another group (a row without a group is
    its own); ``prev_boundary`` is the first row of the own group, or from there
    the first row of the group before. Both stop at the ends of the view.
    """
    lane = Lanes(df, session, order).scan(
        position=position(), _rows=total(), _left=previous(F.col(group))
    )
    island = F.col(group).isNull() | ~F.coalesce(F.col("_left") == F.col(group), F.lit(False))
    lane = lane.scan(_jump=next_seen(F.when(island, F.col("position"))))
    rows = lane.rows()
    heads = rows.where(F.col(group).isNotNull()).groupBy(*session, group).agg(F.min("position").alias("_head"))
    left_heads = heads.select(*session, F.col(group).alias("_left"), F.col("_head").alias("_left_head"))
    headed = join_groups(rows, heads, [*session, group], [row_id], may_lack=group)
    headed = join_groups(headed, left_heads, [*session, "_left"], [row_id], may_lack="_left")
    here, head = F.col("position"), F.col("_head")
    back = F.when(head < here, head).when(here == 1, here).otherwise(F.coalesce(F.col("_left_head"), here - 1))
    return headed.withColumns({
        "next_boundary": F.coalesce(F.col("_jump"), F.col("_rows")), "prev_boundary": back,
    }).drop("_rows", "_left", "_jump", "_head", "_left_head")
