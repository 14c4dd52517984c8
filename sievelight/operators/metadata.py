"""Batch metadata edits: keywords, fields, templates, summaries and undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.templates import expand_template
from sievelight.functions.text import casefold, nfc, sanitize_literal, tidy
from sievelight.operators.lanes import Lanes, position, same_keys, total

_SEP = "\u001f"


def _per_item(items: Column, rule) -> Column:
    """Run a text rule over a whole array in one UDF call.

    The items are joined by a control character that keywords cannot hold, so
    the Arrow hop stays one string per row and only for rows that need Python.
    """
    joined = rule(F.array_join(items, _SEP))
    return F.when(F.size(items) > 0, F.split(joined, _SEP)).otherwise(items)


def sanitize_keywords(items: Column) -> Column:
    """NFC, no control characters, trimmed, empties dropped, order kept."""
    clean = F.transform(F.filter(items, lambda k: k.isNotNull()), lambda k: F.replace(k, F.lit(_SEP), F.lit("")))
    return F.filter(F.transform(_per_item(clean, nfc), tidy), lambda k: k != "")


def add_keywords(existing: Column, incoming: Column, ascii_only: bool = False) -> Column:
    """Additive union: order kept, first spelling wins under full case folding.

    ``existing`` is taken as it is. ``ascii_only`` folds with ``lower`` for text
    known to need no more.
    """
    fold = (lambda a: F.transform(a, F.lower)) if ascii_only else (lambda a: _per_item(a, casefold))
    fresh = F.filter(F.transform(incoming, tidy), lambda k: k != "") if ascii_only else sanitize_keywords(incoming)
    facts = F.struct(existing.alias("old"), fresh.alias("new"), fold(existing).alias("known"), fold(fresh).alias("folded"))

    def unite(row: Column) -> Column:
        # By hashes of the folds, which keep their order and appear once; only new ones look up their first spelling.
        added = F.transform(F.array_except(row["folded"], row["known"]), lambda f: F.get(row["new"], F.array_position(row["folded"], f).cast("int") - 1))
        return F.concat(row["old"], added)

    # A one-element transform names the UDF results, so lambdas may refer to them.
    return F.get(F.transform(F.array(facts), unite), F.lit(0))


def remove_keyword(keywords: Column, keyword: str) -> Column:
    return F.array_remove(keywords, keyword)


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``after`` that really differ. An empty result means the edit is a no-op."""
    old = before.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return after.join(old, keys).where(differs).drop(*[f"_old_{c}" for c in columns])


def field_summary(batch: DataFrame, fields: list[str], by: list[str] = ()) -> DataFrame:
    """Per field the common value, or ``mixed`` when rows differ (NULL is a value).

    One pass with minimum, maximum and count per field, which combine before the
    shuffle; only the one result row per batch is turned into rows per field.
    """
    stats = [F.struct(F.lit(f).alias("field"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("some"))
             for f in fields for v in [F.col(f).cast("string")]]
    wide = batch.groupBy(*by).agg(F.array(*stats).alias("_s"), F.count(F.lit(1)).alias("rows"))
    rows = wide.select(*by, "rows", F.explode("_s").alias("_f")).select(*by, "rows", "_f.*")
    mixed = (F.col("some") > 0) & ((F.col("some") < F.col("rows")) | (F.col("low") != F.col("high")))
    return rows.select(*by, "field", F.when(~mixed, F.col("low")).alias("value"), mixed.alias("mixed"), "rows")


def keyword_coverage(batch: DataFrame, keywords: Column, order: str, row_id: str, by: list[str] = ()) -> DataFrame:
    """Occurrences ``n`` of each keyword, the batch size, and where it was first seen.

    With an integer ``order`` the first place is one decimal (row, then place in
    the row), so that counting stays a hash aggregate instead of a sort.
    """
    words = batch.select(*by, order, F.col(row_id).isNotNull().alias("_row"), F.posexplode_outer(keywords).alias("_at", "keyword"))
    packs = batch.schema[order].dataType.simpleString() in ("int", "bigint")
    if packs:
        shift = F.lit(1 << 31).cast("decimal(12,0)")
        place = F.col(order).cast("decimal(20,0)") * shift + F.col("_at").cast("decimal(12,0)")
        first = F.min(place)
    else:
        first = F.min(F.struct(F.col(order).alias("row"), F.col("_at").alias("at")))
    # A row counts once, at its first word or at none.
    starts = F.count_if(F.col("_row") & (F.coalesce("_at", F.lit(0)) == 0)).alias("_starts")
    seen = words.groupBy(*by, "keyword", F.col("_at").isNull().alias("_none")).agg(F.count(F.lit(1)).alias("n"), first.alias("_first"), starts)
    if packs:
        row = F.floor(F.col("_first") / shift)
        seen = seen.withColumn("_first", F.struct(
            row.cast("bigint").alias("row"), (F.col("_first") - row * shift).cast("int").alias("at")))
    by = list(by)
    # One row per batch, joined by size; a batch with most of the words is split by the skew rule.
    sizes = seen.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by]).agg(F.sum("_starts").alias("total"))
    if not by:
        seen, sizes = seen.withColumn("_one", F.lit(1)), sizes.withColumn("_b__one", F.lit(1))
    keys = by or ["_one"]
    out = seen.where("NOT _none").join(sizes, same_keys(keys, [f"_b_{c}" for c in keys]))
    return out.select(*by, "keyword", "n", "total", F.col("_first.row").alias("first_row"), F.col("_first.at").alias("first_at"))


def apply_template(df: DataFrame, fields: dict[str, str], keywords: list[str], session: list[str],
                   order: list[str], context: str = "context", keyword_col: str | None = "keywords") -> DataFrame:
    """Apply a template to a batch, one row per image in ``order``.

    A field absent from ``fields`` keeps its value; a blank one clears it (NULL);
    another is set to its sanitized expansion, and an empty expansion clears.
    Keywords unite. Every template is parsed before the plan exists, so an
    invalid one raises and changes nothing. The input DataFrame is the snapshot.
    """
    rows = Lanes(df, session, order).scan(_seq=position(), _len=total()).rows()

    def grow(text: str, field: str) -> Column:
        return expand_template(text, F.col(context), F.col("_seq"), F.col("_len"), field)

    new: dict[str, Column] = {}
    for name, text in fields.items():
        if not text.strip():
            new[name] = F.lit(None).cast("string")
        else:
            value = tidy(nfc(grow(text, name)))
            new[name] = F.when(value != "", value)
    if keywords and keyword_col:
        grown = F.array(*[grow(k, "keywords") for k in keywords])
        new[keyword_col] = add_keywords(F.col(keyword_col), grown)
    return rows.withColumns(new).drop("_seq", "_len") if new else rows.drop("_seq", "_len")


def edit_fields(df: DataFrame, batch: DataFrame, keys: list[str], field: str, value: str | None) -> DataFrame:
    """Set one field for the rows of ``batch``; ``None`` clears, blank text is ignored.

    Use ``changed_rows(df, result)`` to see whether the edit counts; ``df`` is the
    snapshot ``revert_batch`` takes.
    """
    if value is not None:
        value = sanitize_literal(value)
        if not value:
            return df
    marked = batch.select(*keys).distinct().withColumn("_in", F.lit(True))
    target = F.lit(value).cast("string")
    return df.join(marked, keys, "left").withColumn(
        field, F.when(F.col("_in"), target).otherwise(F.col(field))
    ).drop("_in")


def revert_batch(state: DataFrame, snapshot: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Put the snapshot's values back; an empty snapshot changes nothing."""
    old = snapshot.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_in"))
    back = {c: F.when(F.col("_in"), F.col(f"_old_{c}")).otherwise(F.col(c)) for c in columns}
    return state.join(old, keys, "left").withColumns(back).drop("_in", *[f"_old_{c}" for c in columns])
