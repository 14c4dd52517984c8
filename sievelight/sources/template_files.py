"""Named metadata templates from a small TOML file, and the checks on them."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.text import trim_unicode
from sievelight.schema import IPTC_FIELDS


class TemplatesFileError(ValueError):
    """The file as a whole is unusable."""


def template_warnings(templates: DataFrame, name: str = "name", field: str = "field", value: str = "value") -> DataFrame:
    """A blank value clears its field wherever the template is applied; say so."""
    blank = templates.where((trim_unicode(F.col(value)) == "") & F.col(field).isin(*IPTC_FIELDS))
    text = F.concat(F.lit("blank "), F.col(field), F.lit(" of "), F.col(name), F.lit(" removes the value it meets"))
    return blank.select(name, field, text.alias("warning"))


def load_templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, errors, warnings), one template row per field or keyword.

    A bad entry is an error row and the others load; a missing file is no rows;
    a file that is not TOML raises. A field that is absent is kept on apply.
    """
    entries: dict = {}
    if os.path.exists(path):
        try:
            with open(path, "rb") as f:
                entries = tomllib.load(f).get("templates", {})
        except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
            raise TemplatesFileError(str(e)) from None
        if not isinstance(entries, dict):
            raise TemplatesFileError("'templates' must be a table")
    rows, errors = [], []
    for name, entry in entries.items():
        words = entry.get("keywords", []) if isinstance(entry, dict) else None
        sound = isinstance(words, list) and all(isinstance(w, str) for w in words) and all(
            isinstance(entry[f], str) for f in IPTC_FIELDS if f in entry)
        if not sound:
            errors.append((name, f"template '{name}': fields are strings, keywords a list of strings"))
            continue
        rows += [(name, f, entry[f], 0) for f in IPTC_FIELDS if f in entry]
        rows += [(name, "keywords", w, i) for i, w in enumerate(words)] or [(name, "keywords", None, 0)]
    templates = spark.createDataFrame(rows, "name string, field string, value string, ord int")
    return templates, spark.createDataFrame(errors, "name string, error string"), template_warnings(templates)


def template_of(templates: DataFrame, name: str) -> tuple[dict[str, str], list[str]]:
    """(fields, keywords) of one template, as ``apply_template`` takes them."""
    rows = templates.where((F.col("name") == name) & F.col("value").isNotNull()).orderBy("ord").collect()
    return ({r.field: r.value for r in rows if r.field != "keywords"}, [r.value for r in rows if r.field == "keywords"])


def save_templates(path: str, templates: dict[str, dict]) -> None:
    """Write templates so that a crash never leaves half a file."""
    def quoted(value) -> str:
        if isinstance(value, list):
            return "[" + ", ".join(map(quoted, value)) + "]"
        plain = value.replace("\\", "\\\\").replace('"', '\\"')
        return '"' + "".join(c if ord(c) >= 32 and ord(c) != 127 else f"\\u{ord(c):04X}" for c in plain) + '"'

    lines = []
    for name, entry in templates.items():
        lines += [f"[templates.{quoted(name)}]", *[f"{k} = {quoted(v)}" for k, v in entry.items() if v is not None], ""]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part-{os.getpid()}"
    with open(part, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
