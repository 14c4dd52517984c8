"""Personal data found from anchors.

One automaton pass finds at-signs, schemes, plus-signs, digits, identifier
cues and the country codes of IBANs. From each anchor a local parser expands to both sides as far as its kind
allows and validates the result, so the cost follows the number of anchors.
Every row stands alone; texts of any length run in memory proportional to
themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.packed import chunks
from sievelight.sources.jobs import ship_package

# The kinds of the base patterns in their order, then those that cues add.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
# Characters of an IBAN by country, without spaces.
_IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_IBAN_CHARS = {code: n for n, codes in _IBAN_CHARS.items() for code in codes.split()}
_ACCOUNT = re.compile(r"(?: (?:no|number|nr)\.?)?[ ]?[:#=]? ?([0-9](?:[ -]?[0-9]){5,19})", re.IGNORECASE)
_SECRET = re.compile(r"[\"']? ?[:=] ?[\"']?([A-Za-z0-9_+/=-]{8,})")
_DIGITS = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_CUES = {
    "iban": ("iban",), "account": ("account", "acct", "konto", "cuenta", "compte", "passport", "ssn"),
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey"),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, marks in {"@": "@", "+": "+", "0": "0123456789", "url": ("://",)}.items():
        for mark in marks:
            found.add_word(mark, (kind, len(mark)))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    for code in _IBAN_CHARS:
        found.add_word(code, ("code", len(code)))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) << (place & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN ends that begins a run of groups, by the length of its country; for other countries the longest run of whole groups; -1 if none."""
    places = [i for i in range(start, end) if text[i] != " "]
    chars = _IBAN_CHARS.get(text[start:start + 2])
    for n in (chars,) if chars else range(len(places), 14, -1):
        if n <= len(places):
            stop = places[n - 1] + 1
            inside = stop < len(text) and text[stop] in _CAPITALS
            if not inside and valid_iban(text[start:stop]):
                return stop
    return -1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def find(text: str, marks: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` of one text by start and then kind; ends are exclusive."""
    done = dict.fromkeys((*KINDS, "chain"), 0)  # where the last match of a kind ended, kept or not
    out: list[tuple[int, int, str]] = []
    for last, (mark, size) in marks.iter(text):
        at = last + 1 - size
        if mark == "0":
            if at and text[at - 1] in "0123456789":
                continue  # only the first digit of a run opens an address or a number
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(map(_octet, m[0].split("."))):
                    out.append((at, m.end(), "ip"))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = _DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and passes_luhn(digits):
                    out.append((at, m.end(), "card"))
        elif mark == "@":
            start, low = at, done["email"]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, last + 1)):
                done["email"] = m.end()
                out.append((start, m.end(), "email"))
        elif mark == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                    out.append((at, m.end(), "phone"))
        elif mark == "url":
            start, low = at, done["url"]
            while start > low and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (m := _URL.match(text, last + 1)):
                end = m.start() + len(m[0].rstrip(".,;:!?)]"))
                done["url"] = m.end()
                if end > m.start():
                    out.append((start, end, "url"))
        elif mark in ("iban", "code"):
            # After its cue, or by itself where a country's code begins a word.
            if at and (text[at - 1].isalpha() or mark == "code" and text[at - 1].isdigit()) or at < done["iban"]:
                continue
            if (m := _IBAN.match(text, at if mark == "code" else last + 1)) and (end := iban_end(text, m.start(1), m.end(1))) > 0:
                done["iban"] = end
                out.append((m.start(1), end, "iban"))
        else:
            pattern = {"account": _ACCOUNT, "secret": _SECRET}[mark]
            if at and text[at - 1].isalpha() or at < done[mark] or not (m := pattern.match(text, last + 1)):
                continue
            done[mark] = m.end(1)
            out.append((m.start(1), m.end(1), mark))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def find_personal(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: its id and ``found``, the spans of its whole text.

    Spans count code points. A null or empty text has none; repeated rows and
    null ids pass as they are; other columns are not read.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = automaton()
        kind = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])
        for batch in chunks(batches):
            spans = [[{"start": a, "stop": b, "kind": k} for a, b, k in find(t, marks)] if t else []
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(kind))], ["id", "found"])

    out = rows.mapInArrow(run, f"id {id_type}, found array<struct<start: int, stop: int, kind: string>>")
    return out.withColumnRenamed("id", id_column)


def spans_text(found: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

