"""Filtered, sorted views of frames and positions inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.operators.lanes import Lanes, join_groups, last_seen, next_seen, position, total


def filter_pick(df: DataFrame, choice: str = "All", pick: str = "pick") -> DataFrame:
    """All / Picked / Rejected / Unmarked."""
    return df if choice == "All" else df.where(F.col(pick) == choice)


def view(df: DataFrame, choice: str = "All", key: str | None = "sort_key", name: str = "file_name",
         tie: str = "path", ascending: bool = True, pick: str = "pick") -> DataFrame:
    """Filter and sort. Rows without ``key`` come last, by name; descending is the
    exact reverse, so they come first. ``key=None`` sorts by name alone."""
    cols = [c for c in (key, name, tie) if c]
    order = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_first() for c in cols]
    return filter_pick(df, choice, pick).orderBy(*order)


def view_positions(df: DataFrame, session: list[str], key: str | None = "sort_key",
                   name: str = "file_name", tie: str = "path", ascending: bool = True) -> DataFrame:
    """1-based ``position`` of every row in its session's view."""
    cols = [c for c in (key, name, tie) if c]
    return Lanes(df, session, cols, not ascending).scan(position=position()).rows()


def load_progress(df: DataFrame, session: list[str], status: str = "status") -> DataFrame:
    """Loaded and total rows per session; a failed row is finished too."""
    done = F.col(status) != "Placeholder"
    return df.groupBy(*session).agg(
        F.count_if(done).alias("loaded"), F.count(F.lit(1)).alias("total"), F.bool_and(done).alias("complete")
    )


def provisional_positions(df: DataFrame, session: list[str], key: str = "sort_key", name: str = "file_name",
                          tie: str = "path", status: str = "status", ascending: bool = True) -> DataFrame:
    """Positions by name until a session is fully loaded, then by capture key."""
    ready = load_progress(df, session, status).select(*session, "complete")
    keyed = join_groups(df, ready, session, [tie]).withColumn("_key", F.when(F.col("complete"), F.col(key)))
    return view_positions(keyed, session, "_key", name, tie, ascending).drop("_key")


def number_batch(df: DataFrame, session: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """1-based ``seq`` and ``batch_len`` in the active order."""
    return Lanes(df, session, order, descending).scan(seq=position(), batch_len=total()).rows()


def nearest_survivor(df: DataFrame, session: list[str], order: list[str], keep: Column, row_id: str) -> DataFrame:
    """Where the cursor goes when its row leaves the view.

    A kept row points to itself. Another takes the nearest kept row by position,
    the earlier one at equal distance. NULL means that the session keeps nothing.
    """
    lane = Lanes(df, session, order).scan(position=position()).with_columns(_keep=keep)
    spot = F.when(F.col("_keep"), F.struct(F.col("position").alias("at"), F.col(row_id).alias("id")))
    rows = lane.scan(_back=last_seen(spot), _ahead=next_seen(spot)).rows()
    back, ahead, here = F.col("_back"), F.col("_ahead"), F.col("position")
    earlier_wins = ahead.isNull() | (back.isNotNull() & (here - back["at"] <= ahead["at"] - here))
    target = F.when(F.col("_keep"), F.col(row_id)).when(earlier_wins, back["id"]).otherwise(ahead["id"])
    return rows.withColumn("survivor", target).drop("_keep", "_back", "_ahead")


def pick_counts(df: DataFrame, by: list[str] = (), pick: str = "pick") -> DataFrame:
    states = [F.count_if(F.col(pick) == s).alias(s.lower()) for s in ("Picked", "Rejected", "Unmarked")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("all"), *states)
