"""Choose one embedded preview per file, and name the output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import name_stem
from sievelight.operators.lanes import Lanes, position

# Pixel bounds of useful previews, caps on plausible claims, and
# how far a preview may be enlarged.
USEFUL_MIN_PIXELS = 100_000
GRID_MAX_PIXELS = 2_100_000
MAX_PAYLOAD_BYTES = 256 * 1024 * 1024
MAX_DECODED_PIXELS = 500_000_000
UPSCALE = 1.25


def _pixels() -> Column:
    return F.col("width").cast("bigint") * F.col("height").cast("bigint")


def flag_implausible(previews: DataFrame) -> DataFrame:
    """Claims no camera makes; such a row must not size a buffer."""
    return previews.withColumn("implausible", (F.col("len") > MAX_PAYLOAD_BYTES) | (_pixels() > MAX_DECODED_PIXELS))


def usable_previews(previews: DataFrame, size: str = "size") -> DataFrame:
    """Inside the file, not empty, and the first of each offset by ``ord``."""
    inside = previews.where((F.col("len") > 0) & (F.col("offset") + F.col("len") <= F.col(size)))
    rest = [c for c in inside.columns if c not in ("path", "offset")]
    first = inside.groupBy("path", "offset").agg(F.min_by(F.struct(*rest), "ord").alias("_r"))
    return first.select("path", "offset", *[F.col(f"_r.{c}").alias(c) for c in rest])


def _choices(previews: DataFrame) -> DataFrame:
    """Per path the grid source and the full-resolution source, in one combined aggregate."""
    px = _pixels()
    row = F.struct("offset", "len", "width", "height")
    whole = F.col("whole_file")
    grid = F.when(~whole & px.between(USEFUL_MIN_PIXELS, GRID_MAX_PIXELS),
                  F.struct(px.alias("p"), (-F.col("len")).alias("l"), (-F.col("offset")).alias("o")))
    above = F.when(~whole & (px > GRID_MAX_PIXELS),
                   F.struct(px.alias("p"), (-F.col("len")).alias("l"), F.col("offset").alias("o")))
    full = F.when(~whole & (px >= USEFUL_MIN_PIXELS),
                  F.struct(px.alias("p"), F.col("len").alias("l"), (-F.col("offset")).alias("o")))
    entire = F.max(F.when(whole, row))
    return previews.groupBy("path").agg(
        F.coalesce(entire, F.max_by(row, grid), F.min_by(row, above)).alias("grid"),
        F.coalesce(entire, F.max_by(row, full)).alias("full"),
    )


def pick_preview(previews: DataFrame, purpose: str = "grid", target_long: int | None = None) -> DataFrame:
    """One preview per file.

    ``grid``: the largest of 100,000 to 2,100,000 pixels, else the smallest above.
    ``full``: the largest of at least 100,000 pixels. With ``target_long``: the
    smaller of those two that can fill a display of that long edge, else the
    larger, and ``terminal`` when no larger one exists. A whole-file image is
    always taken. Files without a useful preview give no row.
    """
    picks = _choices(previews)
    if target_long is None:
        return picks.where(F.col(purpose).isNotNull()).select("path", f"{purpose}.*")
    long = lambda c: F.greatest(F.col(f"{c}.width"), F.col(f"{c}.height"))
    serves = long("grid") * UPSCALE >= target_long
    larger = F.col("full").isNotNull() & (long("full") > long("grid"))
    chosen = (
        F.when(F.col("grid").isNull(), F.col("full")).when(serves | ~larger, F.col("grid")).otherwise(F.col("full"))
    )
    top = F.coalesce(long("full"), long("grid"))
    return (
        picks.withColumn("_pick", chosen).withColumn("_top", top).where(F.col("_pick").isNotNull())
        .select("path", "_pick.*", "_top")
        .withColumn("terminal", F.greatest("width", "height") >= F.col("_top")).drop("_top")
    )


def dedupe_output_names(df: DataFrame, name: str, index: str, by: list[str] = ()) -> DataFrame:
    """``output``: stem.jpg for the first row of a stem, stem_index.jpg for later ones."""
    rows = df.withColumn("_stem", name_stem(F.col(name)))
    placed = Lanes(rows, [*by, "_stem"], [index]).scan(_at=position()).rows()
    later = F.concat(F.lit("_"), F.col(index).cast("string"))
    out = F.concat(F.col("_stem"), F.when(F.col("_at") == 1, F.lit("")).otherwise(later), F.lit(".jpg"))
    return placed.withColumn("output", out).drop("_stem", "_at")
