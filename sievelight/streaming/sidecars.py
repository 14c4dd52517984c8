"""Debounced edits written to the sidecars beside their images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.capture import pick_to_rating
from sievelight.schema import IPTC_FIELDS
from sievelight.session import stored
from sievelight.sources.files import read_files
from sievelight.sources.sidecars import apply_edits, edit_of, iptc_block, keyword_block, render_sidecar
from sievelight.sources.transfer import write_sidecar_files

_ABSENT = "not read: FileNotFoundError"


def per_sidecar(writes: DataFrame, suffix: str = ".xmp") -> DataFrame:
    """One row per sidecar out of the writes of ``coalesce_edits``: in each slot the newest holds.

    ``sets`` says what it sets of the metadata: ``iptc`` (keywords and fields), ``keywords``, or nothing (null).
    """
    mark = F.when(F.col("slot") == "pick", F.col("last_seq"))
    words = F.when(F.col("slot") == "metadata", F.col("last_seq"))
    full = F.when((F.col("slot") == "metadata") & F.col("sets_fields"), F.col("last_seq"))
    return writes.groupBy(F.concat("path", F.lit(suffix)).alias("path")).agg(
        F.max_by("pick", mark).alias("pick"), F.coalesce(F.max_by("keywords", words), F.array().cast("array<string>")).alias("keywords"),
        F.max_by("fields", full).alias("fields"), F.max(mark).isNotNull().alias("marks"),
        F.when(F.max(full).isNotNull(), "iptc").when(F.max(words).isNotNull(), "keywords").alias("sets"))


def edited_sidecars(writes: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, xml, error: each edited sidecar as it is to be written, or why it cannot be.

    A row takes its edits through reading and editing; nothing is joined to the texts, so none of them is ever broadcast or shuffled.
    """
    wanted = per_sidecar(writes)
    fields = {f: F.col(f"fields.{f}") for f in IPTC_FIELDS if f in wanted.schema["fields"].dataType.fieldNames()}
    found = read_files(wanted, tasks=tasks, keep=[c for c in wanted.columns if c != "path"])
    absent = F.coalesce(F.startswith("error", F.lit(_ABSENT)), F.lit(False))
    fresh = render_sidecar(F.coalesce("pick", F.lit("Unmarked")), F.col("keywords"), fields).cast("binary")
    mark = F.when(F.col("marks"), edit_of(F.lit("pick"), F.coalesce(pick_to_rating(F.col("pick")).cast("string"), F.lit(""))))
    block = F.when(F.col("sets") == "iptc", iptc_block(F.col("keywords"), fields)).otherwise(keyword_block(F.col("keywords")))
    edits = F.array_compact(F.array(mark, F.when(F.col("sets").isNotNull(), edit_of(F.col("sets"), block))))
    none = F.filter(edits, lambda _: F.lit(False))
    rows = found.select("path", F.when(absent, fresh).otherwise(F.col("content")).alias("xml"), F.when(absent, none).otherwise(edits).alias("edits"),
                        F.when(~absent, F.col("error")).alias("error"))
    return apply_edits(rows, F.col("edits"), failed="error")


def write_edits(writes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write each edited sidecar: path, ok, reason.

    An existing sidecar keeps every byte that the edits do not own; one that is absent is written fresh. A sidecar that cannot be read or
    edited safely is left alone and told with its reason. Writing the same edits again gives the same files, so a batch may be replayed.
    """
    # All are read before any is written: a task that runs again must not find its own writes.
    edited = stored(edited_sidecars(writes, tasks), "sidecars-edited")
    done = write_sidecar_files(edited.where("error IS NULL"), tasks=tasks, held=True)
    return done.unionByName(edited.where("error IS NOT NULL").select("path", F.lit(False).alias("ok"), F.col("error").alias("reason")))


class SidecarSink:
    """``foreachBatch`` sink for the stream of ``coalesce_edits``; results, one row per sidecar, go to ``ledger.append``."""

    def __init__(self, ledger):
        self.ledger = ledger

    def append(self, batch: DataFrame, batch_id: int) -> None:
        self.ledger.append(stored(write_edits(batch), "sidecar-results"), batch_id)
