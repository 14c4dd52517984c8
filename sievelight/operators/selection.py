"""Selections as tables of ids, and marks given by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.lanes import join_groups


def select_all(view: DataFrame, ids: list[str]) -> DataFrame:
    return view.select(*ids)


def toggle(selection: DataFrame, flipped: DataFrame, ids: list[str]) -> DataFrame:
    """Symmetric difference: selected ids leave, the others come in."""
    kept = selection.select(*ids).join(flipped.select(*ids), ids, "left_anti")
    added = flipped.select(*ids).join(selection.select(*ids), ids, "left_anti")
    return kept.unionByName(added)


def extend_range(view: DataFrame, anchors: DataFrame, base: DataFrame, session: list[str], row_id: str,
                 position: str = "position") -> DataFrame:
    """Rows between two anchors, in either order, united with ``base``.

    ``anchors`` has one (session, anchor, target) row per session; a session
    whose anchor or target is not in the view gets no new rows.
    """
    spots = view.select(*session, row_id, position)
    a = spots.select(*session, F.col(row_id).alias("anchor"), F.col(position).alias("_from"))
    b = spots.select(*session, F.col(row_id).alias("target"), F.col(position).alias("_to"))
    ends = anchors.join(a, [*session, "anchor"]).join(b, [*session, "target"]).select(*session, "_from", "_to")
    low, high = F.least("_from", "_to"), F.greatest("_from", "_to")
    span = join_groups(spots, ends, session, [row_id], "inner").where(F.col(position).between(low, high))
    return span.select(*session, row_id).unionByName(base.select(*session, row_id)).distinct()


def batch_rows(view: DataFrame, selection: DataFrame, session: list[str], row_id: str,
               fallback: DataFrame) -> DataFrame:
    """Selected rows of the view; a session with none falls back to its one
    ``fallback`` row, if that is in the view."""
    ids = [*session, row_id]
    chosen = view.join(selection.select(*ids), ids, "left_semi")
    used = chosen.select(*session).distinct()
    alone = fallback.select(*ids).join(used, session, "left_anti")
    return chosen.unionByName(view.join(alone, ids, "left_semi"))


def count_in_view(view: DataFrame, selection: DataFrame, ids: list[str], by: list[str] = ()) -> DataFrame:
    chosen = view.join(selection.select(*ids), ids, "left_semi")
    return chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("selected"))


def validate_marks(marks: DataFrame, frames: DataFrame, session: list[str], name: str = "file_name") -> DataFrame:
    """Add ``reason``: NULL for a good mark, else why it is refused."""
    known = frames.select(*session, name).distinct().withColumn("_known", F.lit(True))
    asks_path = F.col(name).rlike(r"[/\\:]") | (F.col(name) == "..")
    reason = F.when(asks_path, F.lit("the mark names a folder")).when(
        F.col("_known").isNull(), F.lit("not among the session's files")
    )
    return marks.join(known, [*session, name], "left").withColumn("reason", reason).drop("_known")


def apply_marks(frames: DataFrame, marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Fold ordered marks into ``pick``; the last one wins."""
    last = marks.groupBy(*keys).agg(F.max_by("mark", order).alias("_mark"))
    return frames.join(last, keys, "left").withColumn("pick", F.coalesce("_mark", "pick")).drop("_mark")


def merge_precedence(stored: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """An edited value beats the stored one, column by column.

    ``edits`` holds ``<column>_edited`` flags: an edit may set NULL, so the flag
    decides and not the value.
    """
    new = edits.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], *[f"{c}_edited" for c in columns])
    joined = stored.join(new, keys, "left")
    merged = {c: F.when(F.coalesce(F.col(f"{c}_edited"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c))
              for c in columns}
    return joined.withColumns(merged).drop(*[f"_{c}" for c in columns], *[f"{c}_edited" for c in columns])


def attach_sidecars(frames: DataFrame, sidecars: DataFrame, keys: list[str], pick: str = "pick",
                    keywords: str | None = "keywords") -> DataFrame:
    """Frames without a sidecar are Unmarked with empty metadata."""
    joined = frames.join(sidecars, keys, "left").withColumn(pick, F.coalesce(pick, F.lit("Unmarked")))
    if keywords:
        joined = joined.withColumn(keywords, F.coalesce(keywords, F.array().cast("array<string>")))
    return joined
