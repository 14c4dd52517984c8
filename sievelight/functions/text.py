"""Text rules for names, keywords and metadata fields, as Column expressions.

Only two steps have no Spark built-in: Unicode NFC and full case folding. Both
are the identity, or plain ``lower``, on almost every string, so the Arrow UDF
gets NULL for those rows and ships only the rest to Python.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Below U+0300 every code point is already in NFC, and only these
# five fold to something other than their lower case.
_BELOW_COMBINING = r"^[\x{0000}-\x{02FF}]*$"
_FOLDS_BY_LOWER = r"^[\x{0000}-\x{02FF}&&[^µßŉſǰ]]*$"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s.casefold())


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def nfc(text: Column) -> Column:
    plain = _is_ascii(text) | text.rlike(_BELOW_COMBINING)
    return F.coalesce(F.when(plain, text), _nfc(F.when(~plain, text)))


def casefold(text: Column) -> Column:
    plain = _is_ascii(text) | text.rlike(_FOLDS_BY_LOWER)
    return F.coalesce(F.when(plain, F.lower(text)), _casefold(F.when(~plain, text)))


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cc}", "")


def tidy(text: Column) -> Column:
    """Drop control characters and trim: ``sanitize_text`` for text known to be NFC."""
    return trim_unicode(drop_controls(text))


def sanitize_text(text: Column) -> Column:
    return tidy(nfc(text))


def sanitize_literal(text: str) -> str:
    """``sanitize_text`` for one value typed by a user."""
    return "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) != "Cc").strip()


def xml_escape(text: Column) -> Column:
    out = drop_controls(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only; ``lower`` would also fold accented letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def name_stem(name: Column) -> Column:
    """Up to the last dot; a name whose only dot leads is all stem."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def name_extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)


def split_name(name: Column) -> Column:
    return F.struct(name_stem(name).alias("stem"), name_extension(name).alias("extension"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def canonical_path(path: Column) -> Column:
    """The one form of a path in every table: no ``file:`` in front of a local one, other schemes as they are."""
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def sidecar_path(path: Column) -> Column:
    return F.concat(path, F.lit(".xmp"))


def suffixed_name(name: Column, k: Column) -> Column:
    """``a.ARW``, 2 -> ``a_2.ARW``; a name without a stem takes the suffix at its end."""
    return F.regexp_replace(name, F.lit(r"(?s)^(.+?)(\.[^.]*)?\z"), F.concat(F.lit("$1_"), k, F.lit("$2")))


def normalize_make(make: Column) -> Column:
    return F.when(ascii_lower(make) == "sony", F.lit("Sony")).otherwise(make)


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(trim_unicode(text), r"(?U)\s+", " ")


def keyword_split(text: Column) -> Column:
    """Comma list -> trimmed, non-empty keywords in order."""
    return F.filter(F.transform(F.split(text, ","), trim_unicode), lambda k: k != "")


def first_value_wins(values: Column) -> Column:
    """First value that is not blank, trimmed; NULL when there is none."""
    return F.get(F.filter(F.transform(values, trim_unicode), lambda v: v != ""), F.lit(0))


def inside_folder(source: Column, target: Column) -> Column:
    """Reason why ``target`` cannot receive copies of ``source``; NULL when it can.

    Paths are compared in canonical form, with ``.``, ``..`` and doubled or
    trailing slashes resolved. Links are not followed.
    """
    def clean(path: Column) -> Column:
        def step(parts: Column, part: Column) -> Column:
            up = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
            return F.when(part.isin("", "."), parts).when(part == "..", up).otherwise(F.concat(parts, F.array(part)))

        parts = F.aggregate(F.split(canonical_path(path), "/"), F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), F.array_join(parts, "/"))

    src, dst = clean(source), clean(target)
    prefix = F.when(src == "/", src).otherwise(F.concat(src, F.lit("/")))
    return F.when(dst == src, F.lit("source and target are one folder")).when(
        F.startswith(dst, prefix), F.lit("target lies below the source")
    )


def leaves_folder(name: Column) -> Column:
    """Whether a name, put below a folder, may end up outside of it: it is absolute or goes up."""
    return F.coalesce(name.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\.\.(/|$)"), F.lit(False))
