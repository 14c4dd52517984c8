"""Plan copies of picked files: names, collisions, skips, and the guards before any write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.capture import needs_refresh
from sievelight.functions.templates import expand_template
from sievelight.functions.text import inside_folder, leaves_folder, nfc, sidecar_path, suffixed_name, tidy
from sievelight.operators.lanes import Lanes, join_groups, position, total
from sievelight.session import stored

# A name ending in _k: without an extension, or with one.
_SUFFIXED = r"(?s)^(?:(\.?[^.]+)_([1-9][0-9]*)|(.+)_([1-9][0-9]*)(\.[^.]*))\z"
MODES = ("Rename", "Skip", "Overwrite", "Abort")


class CopyPlanError(ValueError):
    """The plan must not run; nothing has been written."""


def already_copied(plan: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """``copied_before``: this row went to this destination in an earlier run."""
    done = ledger.select(*keys).distinct().withColumn("_done", F.lit(True))
    return plan.join(done, keys, "left").withColumn("copied_before", F.coalesce("_done", F.lit(False))).drop("_done")


def destination_exists(plan: DataFrame, listing: DataFrame, dest: list[str], name: str = "name") -> DataFrame:
    """``taken`` and the mtime of the sidecar beside the planned name.

    A listing row without ``size`` is a sidecar whose image is not there.
    """
    there = listing.select(*dest, name, F.col("size").isNotNull().alias("_there"),
                           F.col("sidecar_mtime").alias("dst_sidecar_mtime"))
    return plan.join(there, [*dest, name], "left").withColumn(
        "taken", F.coalesce("_there", F.lit(False))
    ).drop("_there")


def duplicate_names(plan: DataFrame, dest: list[str], order: list[str], name: str = "name",
                    source: str = "file_name") -> DataFrame:
    """Names that several sources expand to, with the first two sources in order."""
    keys = [*dest, name]
    dups = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = join_groups(plan.select(*dict.fromkeys([*keys, source, *order])), dups, keys, order, "inner")
    first_two = Lanes(rows, keys, order).scan(_at=position()).rows().where("_at <= 2")
    pick = lambda at: F.max(F.when(F.col("_at") == at, F.col(source)))
    return first_two.groupBy(*keys).agg(F.max("copies").alias("copies"), pick(1).alias("first"), pick(2).alias("second"))


def assign_free_suffix(wanted: DataFrame, taken: DataFrame, dest: list[str], name: str = "name") -> DataFrame:
    """Add ``free_name``: ``stem_k.ext`` with the smallest free k >= 2.

    Set form of the suffix search: every taken name is read once as (base, k) and gives itself and k + 1. What only comes as
    a successor is free, and the smallest of a base follows its unbroken run 2, 3, ... Both steps are combined aggregates, so a
    base with any number of suffixes is no single task's. Suffixed forms of different names never meet, so no name is tried twice.
    """
    # A path separator cannot occur in a name, so it can part base and number.
    parsed = F.regexp_replace(F.col(name), _SUFFIXED, "$1$3$5/$2$4")
    numbered = F.filter(F.array(F.split(parsed, "/")), lambda p: F.size(p) == 2)
    used = (
        taken.where(F.contains(F.col(name), F.lit("_")))
        .select(*dest, F.explode(numbered).alias("_p"))
        .select(*dest, F.col("_p")[0].alias(name), F.col("_p")[1].try_cast("bigint").alias("_k"))
        .where("_k >= 2")
        .join(wanted.select(*dest, name).distinct(), [*dest, name], "left_semi")
    )
    # Without its highest number a run of all numbers has no successor; nothing wraps around.
    both = F.array(F.struct(F.col("_k").alias("k"), F.lit(True).alias("own")), F.struct(F.try_add(F.col("_k"), F.lit(1)).alias("k"), F.lit(False).alias("own")))
    steps = used.select(*dest, name, F.explode(both).alias("_s")).select(*dest, name, F.col("_s.k").alias("_k"), F.col("_s.own").alias("_own"))
    seen = steps.where("_k IS NOT NULL").groupBy(*dest, name, "_k").agg(F.max("_own").alias("_own"))
    first = F.min(F.when(F.col("_own"), F.col("_k")))
    gaps = seen.groupBy(*dest, name).agg(F.when(first > 2, F.lit(2)).otherwise(F.min(F.when(~F.col("_own"), F.col("_k")))).alias("_free"))
    free = F.coalesce(F.col("_free"), F.lit(2)).cast("string")
    return wanted.join(gaps, [*dest, name], "left").withColumn("free_name", suffixed_name(F.col(name), free)).drop("_free")


def plan_actions(sources: DataFrame, listing: DataFrame, ledger: DataFrame | None = None, *,
                 template: str | None = None, mode: str = "Rename", session: list[str] = ("session_id",),
                 dest: list[str] = ("dest",), row_id: str = "image_id", order: list[str],
                 include_failed: bool = False) -> DataFrame:
    """One row per source with all of its plan but a free name: ``natural_name``, ``action``, ``bytes``, ``taken``.

    Enough for totals and guards: only a renamed row needs a look at other names.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    session, dest = list(session), list(dest)
    if "status" in sources.columns and not include_failed:
        sources = sources.where("status <> 'Failed'")
    if template and template.strip():
        numbered = Lanes(sources, session, order).scan(seq=position(), batch_len=total()).rows()
        name = tidy(nfc(expand_template(template, F.col("context"), F.col("seq"), F.col("batch_len"), "rename")))
        named = numbered.withColumn("name", name)
    else:
        named = sources.withColumn("name", F.col("file_name"))
    if ledger is None:
        known = named.withColumn("copied_before", F.lit(False))
    else:
        known = already_copied(named, ledger, [*dest, row_id])
    placed = destination_exists(known, listing, dest)
    skip = F.col("copied_before") | (F.col("taken") if mode == "Skip" else F.lit(False))
    renamed = F.col("taken") if mode == "Rename" else F.lit(False)
    refresh = needs_refresh(F.col("src_sidecar_mtime"), F.col("dst_sidecar_mtime"))
    action = (
        F.when(skip & refresh, F.lit("SidecarRefresh")).when(skip, F.lit("Skip"))
        .when(renamed, F.lit("CopyRenamed")).otherwise(F.lit("Copy"))
    )
    planned = placed.withColumn("action", action).withColumnRenamed("name", "natural_name").drop("dst_sidecar_mtime")
    moves = F.col("action").isin("Copy", "CopyRenamed")
    return planned.withColumn("bytes", F.when(moves, F.col("size")).otherwise(F.lit(0)).cast("bigint"))


def plan_copy(sources: DataFrame, listing: DataFrame, ledger: DataFrame | None = None, *, dest: list[str] = ("dest",),
              order: list[str], **options) -> DataFrame:
    """One row per source: ``name``, ``action``, ``bytes``, ``taken``, ``refused``.

    ``sources`` needs file_name, size, src_sidecar_mtime and, for a template, the
    ``context`` struct; with a ``status`` column, failed files stay out unless
    asked for. Every name a source takes by itself is reserved, so a renamed row
    never lands on another's target. ``refused`` says why a row must not run: its name leaves the
    destination, or several sources take it. ``copy_files`` leaves such rows alone, and
    ``guard_plan`` stops the whole plan. ``options`` are those of ``plan_actions``. Actions are written to a table
    first, since names are looked at several times.
    """
    dest = list(dest)
    acted = stored(plan_actions(sources, listing, ledger, dest=dest, order=order, **options), "plan")
    shared = acted.groupBy(*dest, "natural_name").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    acted = acted.join(shared, [*dest, "natural_name"], "left")
    if options.get("mode", "Rename") == "Rename":
        clash = acted.where("action = 'CopyRenamed'").select(*dest, F.col("natural_name").alias("name")).distinct()
        reserved = listing.where("size is not null").select(*dest, "name").unionByName(
            acted.select(*dest, F.col("natural_name").alias("name")))
        free = assign_free_suffix(clash, reserved, dest).withColumnRenamed("name", "natural_name")
        moved = acted.where("action = 'CopyRenamed'").join(free, [*dest, "natural_name"], "left")
        rest = acted.where("action <> 'CopyRenamed'").withColumn("free_name", F.lit(None).cast("string"))
        acted = rest.unionByName(moved)
    else:
        acted = acted.withColumn("free_name", F.lit(None).cast("string"))
    name = F.when(F.col("action") == "CopyRenamed", F.col("free_name")).otherwise(F.col("natural_name"))
    refused = F.when(leaves_folder(F.col("natural_name")), "the name leaves the destination").when(
        F.col("_copies").isNotNull(), "several sources take this name")
    return acted.withColumns({"name": name, "refused": refused}).withColumn(
        "dst_sidecar", sidecar_path(F.col("name"))).drop("free_name", "_copies")


def plan_summary(plan: DataFrame, free_bytes: int | None = None, by: list[str] = ()) -> DataFrame:
    """Totals of a plan; ``fits`` is NULL when the free space is not known."""
    tally = {n: F.count_if(F.col("action") == a).alias(n) for n, a in
             (("renamed", "CopyRenamed"), ("skipped", "Skip"), ("refreshed", "SidecarRefresh"))}
    moved = F.coalesce(F.sum(F.when(F.col("action").isin("Copy", "CopyRenamed"), F.col("bytes"))), F.lit(0))
    totals = plan.groupBy(*by).agg(F.count(F.lit(1)).alias("jobs"), moved.alias("total_bytes"), *tally.values())
    return totals.withColumn("fits", F.col("total_bytes") <= F.lit(free_bytes).cast("bigint"))


def guard_plan(plan: DataFrame, *, mode: str = "Rename", dest: list[str] = ("dest",), order: list[str],
               free_bytes: int | None = None, folders: tuple[str, str] | None = None) -> DataFrame:
    """Raise ``CopyPlanError`` when the plan must not run, else return it.

    Each guard is a combined aggregate or a two-row lookup; no plan row reaches
    the driver.
    """
    if folders:
        reason = plan.sparkSession.range(1).select(inside_folder(F.lit(folders[0]), F.lit(folders[1]))).first()[0]
        if reason:
            raise CopyPlanError(reason)
    out = plan.where(leaves_folder(F.col("natural_name"))).select("natural_name").first()
    if out:
        raise CopyPlanError(f"{out.natural_name} would lie outside the destination")
    clash = duplicate_names(plan, list(dest), order, "natural_name").orderBy(*dest, "natural_name").first()
    if clash:
        raise CopyPlanError(f"{clash.first} and {clash.second} would both become {clash.natural_name}")
    if mode == "Abort":
        hits = plan.where("taken").count()
        if hits:
            raise CopyPlanError(f"{hits} target names are in use")
    if free_bytes is not None:
        need = plan.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        if need > free_bytes:
            raise CopyPlanError(f"the copies take {need} bytes and {free_bytes} are free")
    return plan


def preview_names(plan: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    return plan.orderBy(*order).limit(n).select("name")


def verify_copies(source: DataFrame, copied: DataFrame, key: str = "name") -> DataFrame:
    """Compare both sides by size and hash: match, mismatch, missing, extra, or unreadable where a side has no hash."""
    a = source.select(key, F.struct("size", "hash").alias("_a"))
    b = copied.select(key, F.struct("size", "hash").alias("_b"))
    a_col, b_col = F.col("_a"), F.col("_b")
    verdict = (
        F.when(b_col.isNull(), F.lit("missing")).when(a_col.isNull(), F.lit("extra"))
        .when(a_col["hash"].isNull() | b_col["hash"].isNull(), F.lit("unreadable"))
        .when(a_col.eqNullSafe(b_col), F.lit("match")).otherwise(F.lit("mismatch"))
    )
    return a.join(b, key, "full_outer").select(key, verdict.alias("verdict"))


def copy_report(results: DataFrame, cancelled: bool = False, by: list[str] = ()) -> DataFrame:
    """One row of counts. ``verified`` needs something copied, no failure and no cancel.

    Failed rows and copied ids stay tables of their own (``failures``,
    ``copied_rows``), since their number has no bound.
    """
    ok = F.col("ok")
    copied = F.count_if(ok & F.col("action").isin("Copy", "CopyRenamed"))
    failed = F.count_if(~ok)
    return results.groupBy(*by).agg(
        copied.alias("copied"), F.count_if(ok & (F.col("action") == "Skip")).alias("skipped"),
        F.count_if(ok & (F.col("action") == "SidecarRefresh")).alias("refreshed"), failed.alias("failed"),
        ((copied > 0) & (failed == 0) & ~F.lit(cancelled)).alias("verified"),
    )


def failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("ok"))


def copied_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("ok") & F.col("action").isin("Copy", "CopyRenamed"))


def run_report(results: DataFrame, seconds: float, by: list[str] = ()) -> DataFrame:
    """Finished, cached and failed files, files per second, and the exit code."""
    failed = F.count_if(F.col("status") == "Failed")
    return results.groupBy(*by).agg(
        F.count_if(F.col("status") != "Failed").alias("done"), F.count_if("from_cache").alias("from_cache"),
        failed.alias("failed"), (F.count(F.lit(1)) / F.lit(float(seconds))).alias("files_per_second"),
        F.when(failed > 0, F.lit(2)).otherwise(F.lit(0)).alias("exit_code"),
    )
