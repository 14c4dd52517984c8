"""Text templates: ``{variables}`` parsed once on the driver into one ``concat``.

Errors surface while the plan is built, so a bad template changes no row. A
value that itself holds braces is never expanded again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEQ_WIDTH = 32
VARIABLES = ("date", "time", "filename", "camera", "ext")
_PIECE = re.compile(r"(?P<escape>\{\{|\}\})|\{(?P<name>[^}]*)\}|(?P<open>\{)|(?P<text>[^{}]+|\})", re.S)


class TemplateError(ValueError):
    """The template cannot be expanded for any row."""


class UnknownVariable(TemplateError):
    pass


class UnclosedBrace(TemplateError):
    pass


class BadSeqWidth(TemplateError):
    pass


def template_pieces(text: str, field: str = "template") -> list[tuple[str, str | int | None]]:
    """Split into ("text", s), ("var", name) and ("seq", width or None) pieces."""
    pieces: list[tuple[str, str | int | None]] = []
    for m in _PIECE.finditer(text):
        if m["escape"]:
            pieces.append(("text", m["escape"][0]))
        elif m["text"]:
            pieces.append(("text", m["text"]))
        elif m["open"]:
            raise UnclosedBrace(f"unclosed '{{' in {field}; write a literal brace as '{{{{'")
        elif m["name"] in VARIABLES:
            pieces.append(("var", m["name"]))
        elif m["name"] == "seq":
            pieces.append(("seq", None))
        elif m["name"].startswith("seq:"):
            width = m["name"][4:]
            if not re.fullmatch(r"\+?[0-9]+", width) or not 1 <= int(width) <= MAX_SEQ_WIDTH:
                raise BadSeqWidth(f"'{{seq:{width}}}' in {field}: width must be 1..{MAX_SEQ_WIDTH}")
            pieces.append(("seq", int(width)))
        else:
            raise UnknownVariable(f"unknown variable '{{{m['name']}}}' in {field}")
    return pieces


def pad_number(number: Column, width: Column) -> Column:
    """Zero-pad to ``width``, never cutting (``lpad`` alone cuts long numbers)."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(width.cast("int"), F.length(text)), F.lit("0"))


def expand_template(text: str, context: Column, seq: Column, batch_len: Column,
                    field: str = "template") -> Column:
    """``context`` is the struct of ``capture_context``; ``seq`` is the 1-based place."""
    default = F.length(F.greatest(batch_len, F.lit(1)).cast("string"))
    parts = []
    for kind, value in template_pieces(text, field):
        if kind == "text":
            parts.append(F.lit(value))
        elif kind == "var":
            parts.append(context[value])
        else:
            parts.append(pad_number(seq, default if value is None else F.lit(value)))
    return F.concat(*parts) if parts else F.lit("")
