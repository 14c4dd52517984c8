"""XMP sidecars: read into columns, render from columns, rewrite in place.

Rendering is one Column expression. Parsing and editing need an XML reader,
which Spark has not (its ``xpath`` fails the whole job on one bad file), so a
small helper per file runs inside ``mapInPandas`` and the rules about the
values it returns are Column expressions again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.capture import pick_to_rating, rating_to_pick
from sievelight.functions.text import first_value_wins, trim_unicode, xml_escape
from sievelight.schema import IPTC_FIELDS
from sievelight.sources.files import SHARES, list_folders, read_files
from sievelight.sources.jobs import per_file

# The property behind each metadata field, in writing order, and
# the shape it is written in.
PROPERTIES = {
    "title": ("dc:title", "alt"),
    "description": ("dc:description", "alt"),
    "creator": ("dc:creator", "seq"),
    "rights": ("dc:rights", "alt"),
    "headline": ("photoshop:Headline", "simple"),
    "city": ("photoshop:City", "simple"),
    "country": ("photoshop:Country", "simple"),
    "credit": ("photoshop:Credit", "simple"),
    "source": ("photoshop:Source", "simple"),
    "job_id": ("photoshop:TransmissionReference", "simple"),
    "location": ("Iptc4xmpCore:Location", "simple"),
}
# Namespace addresses of the standard schemas.
NAMESPACES = {
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "lr": "http://ns.adobe.com/lightroom/1.0/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "Iptc4xmpCore": "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/",
}
_FIELD_OF = {prop.split(":")[1]: field for field, (prop, _) in PROPERTIES.items()}
_KEYWORD_BAGS = {"subject", "hierarchicalSubject"}
_RATINGS = {"xmp:Rating", "xap:Rating"}


# -- render -------------------------------------------------------------------

def keyword_block(keywords: Column) -> Column:
    """Both keyword bags; empty text for an empty list."""
    items = F.array_join(
        F.transform(keywords, lambda k: F.concat(F.lit("     <rdf:li>"), xml_escape(k), F.lit("</rdf:li>\n"))), "")
    bags = [F.concat(F.lit(f"\n   <{p}>\n    <rdf:Bag>\n"), items, F.lit(f"    </rdf:Bag>\n   </{p}>"))
            for p in ("dc:subject", "lr:hierarchicalSubject")]
    return F.when(F.size(keywords) > 0, F.concat(*bags)).otherwise(F.lit(""))


def iptc_block(keywords: Column, fields: dict[str, Column]) -> Column:
    """Keyword bags and one element per field that is not NULL."""
    shapes = {
        "alt": ('\n    <rdf:Alt>\n     <rdf:li xml:lang="x-default">', "</rdf:li>\n    </rdf:Alt>\n   "),
        "seq": ("\n    <rdf:Seq>\n     <rdf:li>", "</rdf:li>\n    </rdf:Seq>\n   "),
        "simple": ("", ""),
    }
    parts = [keyword_block(keywords)]
    for field, (prop, shape) in PROPERTIES.items():
        if field in fields:
            opening, closing = shapes[shape]
            parts.append(F.coalesce(F.concat(
                F.lit(f"\n   <{prop}>{opening}"), xml_escape(fields[field]), F.lit(f"{closing}</{prop}>")), F.lit("")))
    return F.concat(*parts)


def render_sidecar(pick: Column, keywords: Column | None = None, fields: dict[str, Column] | None = None,
                   toolkit: str = "sievelight") -> Column:
    """A fresh sidecar. Without metadata the rating stands on its own line."""
    rating = pick_to_rating(pick).cast("string")
    block = iptc_block(keywords if keywords is not None else F.array().cast("array<string>"), fields or {})
    attribute = lambda sep: F.coalesce(F.concat(F.lit(f'{sep}xmp:Rating="'), rating, F.lit('"')), F.lit(""))
    spaces = "".join(f' xmlns:{p}="{NAMESPACES[p]}"' for p in ("dc", "lr", "photoshop", "Iptc4xmpCore"))
    head = (f'<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{toolkit}">\n'
            ' <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n  <rdf:Description rdf:about=""')
    space = f'xmlns:xmp="{NAMESPACES["xmp"]}"'
    bare = F.concat(F.lit(f"\n    {space}"), attribute("\n    "), F.lit(">"))
    full = F.concat(F.lit(f" {space}"), attribute(" "), F.lit(f"{spaces}>"), block)
    return F.concat(F.lit(head), F.when(block == "", bare).otherwise(full),
                    F.lit('\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'))


# -- read ---------------------------------------------------------------------

def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def _facts(xml: bytes) -> list[tuple[str, str]]:
    """(what, text) pairs in document order: rating, keyword, or a field name."""
    facts: list[tuple[str, str]] = []
    stack: list[tuple[str, str | None]] = []
    taken: set[int] = set()
    parser = expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, len(xml) + 1  # a long text stays in one piece

    def opened(name: str, attrs: dict) -> None:
        if _local(name) == "Description":
            for key, value in attrs.items():
                what = "rating" if key in _RATINGS else _FIELD_OF.get(_local(key))
                if what:
                    facts.append((what, value))
        stack.append((name, "rating" if name in _RATINGS else _FIELD_OF.get(_local(name))))

    def text(data: str) -> None:
        if not data.strip():
            return
        names = [_local(n) for n, _ in stack]
        if "subject" in names and "li" in names[names.index("subject"):]:
            facts.append(("keyword", data))
            return
        depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] and _local(stack[i][0]) != "Description"), None)
        if depth is not None and depth not in taken:
            what = stack[depth][1]
            facts.append((what, data))
            if what != "rating":
                taken.add(depth)  # only the first text of a property counts

    def closed(_: str) -> None:
        stack.pop()
        taken.discard(len(stack))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, text
    parser.CommentHandler = lambda _: None  # a comment parts two texts
    parser.Parse(xml, True)
    return facts


def parse_sidecars(df: DataFrame, content: str = "content", path: str = "path", failed: str | None = None) -> DataFrame:
    """path, pick, keywords, iptc, error. A malformed file is a row with ``error``, never a default.

    ``failed`` names a column whose text, where there is any, is the error of a row that could not be read.
    """
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            known = batch[failed] if failed else [None] * len(batch)
            for key, raw, error in zip(batch[path], batch[content], known):
                facts = []
                try:
                    if not error:
                        data = raw.encode() if isinstance(raw, str) else bytes(raw)
                        data.decode("utf-8")
                        facts = [{"what": w, "text": t} for w, t in _facts(data)]
                except UnicodeDecodeError:
                    error = "bytes are not UTF-8 text"
                except expat.ExpatError as e:
                    error = f"malformed XML: {e}"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((key, facts, error))
            yield pd.DataFrame(out, columns=["path", "facts", "error"])

    raw = per_file(df.select(path, content, *([failed] if failed else [])), job,
                   "path string, facts array<struct<what:string,text:string>>, error string", held=True)

    def texts(what: str) -> Column:
        return F.transform(F.filter("facts", lambda f: f["what"] == what), lambda f: f["text"])

    ratings = F.filter(F.transform(texts("rating"), lambda t: F.when(
        trim_unicode(t).rlike(r"^[+-]?[0-9]{1,10}$"), trim_unicode(t).try_cast("int"))), lambda r: r.isNotNull())
    # Documents state a rating more than once: the last that parses holds.
    pick = rating_to_pick(F.coalesce(F.try_element_at(ratings, F.lit(-1)), F.lit(0)))
    fine = F.col("error").isNull()
    iptc = F.struct(*[first_value_wins(texts(f)).alias(f) for f in IPTC_FIELDS])
    return raw.select(
        "path", F.when(fine, pick).alias("pick"),
        F.when(fine, F.transform(texts("keyword"), trim_unicode)).alias("keywords"),
        F.when(fine, iptc).alias("iptc"), "error")


def read_sidecars(spark: SparkSession, paths: str | list[str], suffix: str = ".xmp", tasks: int | None = None) -> DataFrame:
    """Sidecars directly inside the folders ``paths``, keyed by the image path they belong to.

    Listed like frames, so the paths match theirs and an empty or unreadable
    sidecar is a row with ``error``.
    """
    files = list_folders(spark.createDataFrame([(p,) for p in ([paths] if isinstance(paths, str) else paths)], "folder string"), shares=SHARES)
    cars = files.where(F.col("path").isNotNull() & F.endswith(F.col("path"), F.lit(suffix)))
    image = F.left(F.col("path"), F.length("path") - F.lit(len(suffix)))
    read = read_files(cars.select("path"), tasks=tasks)
    return parse_sidecars(read.select(image.alias("path"), "content", "error"), failed="error")


# -- rewrite ------------------------------------------------------------------

_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^<>\[]|\[.*?\])*>"
                    r"|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+", re.S)
_TAG = re.compile(r"<(/?)([^\s/>]+)(.*?)(/?)>\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(\"[^\"]*\"|'[^']*')", re.S)

# What each kind of edit owns: elements and attributes to drop, and prefixes its block needs.
_EDITS = {
    "pick": (lambda n: n in _RATINGS, lambda a: a in _RATINGS, ("xmp",)),
    "keywords": (lambda n: _local(n) in _KEYWORD_BAGS, lambda a: False, ("dc", "lr")),
    "iptc": (lambda n: _local(n) in _KEYWORD_BAGS or _local(n) in _FIELD_OF, lambda a: _local(a) in _FIELD_OF,
             ("dc", "lr", "photoshop", "Iptc4xmpCore")),
}


def edit_sidecar(xml: str, kind: str, new: str) -> str:
    """Replace what ``kind`` owns by ``new`` in the first Description; keep every other byte.

    ``new`` is a rating for "pick" and rendered elements otherwise; empty text
    removes. Raises ``ValueError`` when the document cannot be edited safely.
    """
    try:
        expat.ParserCreate().Parse(xml.encode(), True)
    except expat.ExpatError as e:
        raise ValueError(f"malformed XML: {e}") from None
    owned_element, owned_attribute, prefixes = _EDITS[kind]
    out: list[str] = []
    dropping = inside = seen = 0
    for token in _TOKEN.findall(xml):
        tag = None if token.startswith(("<!", "<?")) else _TAG.match(token)
        if not tag:
            if not dropping:
                out.append(token)
            continue
        closing, name, attributes, empty = tag.groups()
        described = _local(name) == "Description"
        if owned_element(name) and (kind != "pick" or inside or dropping):
            if not closing and not dropping and kind != "pick" and out and not out[-1].strip(" \t\r\n"):
                out.pop()  # the indent of a dropped element goes with it
            dropping += 0 if empty else -1 if closing else 1
            continue
        if dropping:
            continue
        inside += (-1 if closing else 0 if empty else 1) if described or inside else 0
        if closing or not described or (kind == "keywords" and seen):
            out.append(token)
            continue
        kept = [(k, v) for k, v in _ATTRIBUTE.findall(attributes) if not owned_attribute(k)]
        if not seen and new:
            have = {k for k, _ in kept}
            kept += [(f"xmlns:{p}", f'"{NAMESPACES[p]}"') for p in prefixes if f"xmlns:{p}" not in have]
            kept += [("xmp:Rating", f'"{new}"')] if kind == "pick" else []
        start = f"<{name}" + "".join(f" {k}={v}" for k, v in kept)
        if kind == "pick":
            out.append(f"{start}{empty}>")
        else:
            out.append(f"{start}>")
            out.append("" if seen else new)
            out.append(f"</{name}>" if empty else "")
            out = [t for t in out if t]
        seen += 1
    if not seen:
        raise ValueError("nothing to edit, rdf:Description is missing")
    return "".join(out)


def rewrite_sidecars(df: DataFrame, kind: str, new: Column, xml: str = "xml", path: str = "path") -> DataFrame:
    """path, xml, error: existing sidecar text with one kind of state replaced.

    ``kind`` is "pick" (``new`` = rating), "keywords" or "iptc" (``new`` = the
    block of ``keyword_block`` / ``iptc_block``). ``xml`` may be text or bytes.
    """
    return apply_edits(df, F.array(edit_of(F.lit(kind), new)), xml, path)


def edit_of(kind: Column, new: Column) -> Column:
    return F.struct(kind.alias("kind"), new.cast("string").alias("new"))


def apply_edits(df: DataFrame, edits: Column, xml: str = "xml", path: str = "path", failed: str | None = None) -> DataFrame:
    """path, xml, error: sidecars after the row's own ``edits``, an array of ``edit_of``, one after the other; without any the text stays.

    ``failed`` names a column whose text, where there is any, is the error of a row that could not be read.
    """
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, raw, edits, error in zip(batch["path"], batch["xml"], batch["edits"], batch["failed"]):
                text = None
                try:
                    if not error:
                        text = raw if isinstance(raw, str) else bytes(raw).decode("utf-8")
                        for edit in edits:
                            text = edit_sidecar(text, edit["kind"], edit["new"] or "")
                except UnicodeDecodeError:
                    text, error = None, "bytes are not UTF-8 text"
                except Exception as e:
                    text, error = None, str(e) if type(e) is ValueError else f"{type(e).__name__}: {e}"
                out.append((key, text, error))
            yield pd.DataFrame(out, columns=["path", "xml", "error"], dtype=object)

    known = F.col(failed) if failed else F.lit(None).cast("string")
    rows = df.select(F.col(path).alias("path"), F.col(xml).alias("xml"), edits.alias("edits"), known.alias("failed"))
    return per_file(rows, job, "path string, xml string, error string", held=True)
