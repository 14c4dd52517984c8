"""Sidecars rendered from documents, read back, rewritten and written; templates and copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions.text import file_name
from sievelight.operators import copyplan as P
from sievelight.plans.registry import dealt, query, table
from sievelight.session import shared_folder
from sievelight.sources import sidecars as X
from sievelight.sources.files import read_files, scan_files
from sievelight.sources.template_files import template_warnings
from sievelight.sources.transfer import copy_files, hash_files, write_sidecar_files
from sievelight.streaming.edits import coalesce_edits
from sievelight.streaming.sidecars import write_edits


def _state(spark, sf):
    """A document is one image: whole text as description, language and source as keywords."""
    pick = F.when(F.col("lang") == "de", "Picked").when(F.col("lang") == "fr", "Rejected").otherwise("Unmarked")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".ARW")).alias("path"), pick.alias("pick"),
        F.array("lang", F.concat(F.lit("a&b <"), F.col("source"))).alias("keywords"), F.col("text").alias("description"),
        F.when(F.col("lang") == "en", F.col("source")).alias("city"))


def _xml(rows):
    return rows.withColumn("xml", X.render_sidecar(
        F.col("pick"), F.col("keywords"), {"description": F.col("description"), "city": F.col("city")}))


def _rendered(spark, sf):
    return _xml(dealt(_state(spark, sf)))


def _both_forms(rows, bare=None):
    """Two images out of each document: one with keywords and the whole text (.ARW) and, where ``bare`` holds if it is given, one of marks alone (.JPG)."""
    other = F.concat(F.col("doc_id").cast("string"), F.lit(".JPG"))
    full, marks = [F.struct(path.alias("path"), xml.alias("xml")) for path, xml in ((F.col("path"), F.col("xml")), (other, _bare()))]
    return rows.select(F.inline(F.array_compact(F.array(full, marks if bare is None else F.when(bare, marks)))))


_ESCAPE = r"replace(replace(replace(regexp_replace({}, '[\x00-\x1f\x7f-\x9f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RATING = "CASE lang WHEN 'de' THEN '{0}xmp:Rating=\"1\"' WHEN 'fr' THEN '{0}xmp:Rating=\"-1\"' ELSE '' END"
_SPACES = "".join(f' xmlns:{p}="{X.NAMESPACES[p]}"' for p in ("dc", "lr", "photoshop", "Iptc4xmpCore"))


def _lines(*parts: str) -> str:
    """SQL text for lines: 'a' || chr(10) || 'b'."""
    return " || chr(10) || ".join(parts)


_BAG = _lines("'    <rdf:Bag>'", "'     <rdf:li>' || lang || '</rdf:li>'",
              "'     <rdf:li>a&amp;b &lt;' || source || '</rdf:li>'", "'    </rdf:Bag>'")
_BLOCK = _lines("''", "'   <dc:subject>'", _BAG, "'   </dc:subject>'", "'   <lr:hierarchicalSubject>'", _BAG, "'   </lr:hierarchicalSubject>'",
                "'   <dc:description>'", "'    <rdf:Alt>'",
                "'     <rdf:li xml:lang=\"x-default\">' || " + _ESCAPE.format("text") + " || '</rdf:li>'",
                "'    </rdf:Alt>'", "'   </dc:description>'") + \
    " || CASE WHEN lang = 'en' THEN chr(10) || '   <photoshop:City>' || source || '</photoshop:City>' ELSE '' END"
_HEAD = _lines("'<?xpacket begin=\"\" id=\"W5M0MpCehiHzreSzNTczkc9d\"?>'",
               "'<x:xmpmeta xmlns:x=\"adobe:ns:meta/\" x:xmptk=\"sievelight\">'",
               "' <rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\">'", "'  <rdf:Description rdf:about=\"\"'")
_XMP = 'xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
_TAIL = _lines("''", "'  </rdf:Description>'", "' </rdf:RDF>'", "'</x:xmpmeta>'", "'<?xpacket end=\"w\"?>'", "''")
_XML = f"{_HEAD} || ' {_XMP}' || {_RATING.format(' ')} || '{_SPACES}>' || {_BLOCK} || {_TAIL}"
_MARKS = f"{_HEAD} || chr(10) || '    {_XMP}' || {_RATING.format(chr(10) + '    ')} || '>' || {_TAIL}"


def _bare():
    """The sidecar of marks alone, without keywords and texts."""
    return X.render_sidecar(F.col("pick"), F.array().cast("array<string>"), {})


@query("render_sidecars", f"SELECT doc_id, md5({_XML}) AS xml, md5({_MARKS}) AS marks FROM documents")
def render_sidecars(spark, sf):
    """Both forms of every document's sidecar: with keywords and the whole text, and of marks alone."""
    return _xml(_state(spark, sf)).select("doc_id", F.md5("xml").alias("xml"), F.md5(_bare()).alias("marks"))


def _marks(spark, sf):
    return _state(spark, sf).withColumn("xml", _bare())


@query("render_sidecars_marks", f"SELECT doc_id, {_MARKS} AS xml FROM documents")
def render_sidecars_marks(spark, sf):
    return _marks(spark, sf).select("doc_id", "xml")


@query("read_sidecars", r"""
WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g')) AS t FROM documents)
SELECT CAST(doc_id AS VARCHAR) || '.ARW' AS path,
  CASE lang WHEN 'de' THEN 'Picked' WHEN 'fr' THEN 'Rejected' ELSE 'Unmarked' END AS pick,
  lang || '|a&b <' || source AS keywords, CASE WHEN t <> '' THEN md5(t) END AS description, CASE WHEN lang = 'en' THEN source END AS city, CAST(NULL AS VARCHAR) AS error
FROM d""")
def read_sidecars(spark, sf):
    parsed = X.parse_sidecars(_rendered(spark, sf), "xml")
    return parsed.select("path", "pick", F.array_join("keywords", "|").alias("keywords"),
                         F.md5("iptc.description").alias("description"), F.col("iptc.city").alias("city"), "error")


@query("read_sidecars_malformed", """
SELECT CAST(doc_id AS VARCHAR) || '.ARW' AS path, CAST(NULL AS VARCHAR) AS pick, TRUE AS failed FROM documents""")
def read_sidecars_malformed(spark, sf):
    """Junk after the root and raw text are error rows, not defaults and not a failed job."""
    broken = _rendered(spark, sf).withColumn("xml", F.when(F.col("doc_id") % 2 == 0, F.concat("xml", F.lit("<"))).otherwise(F.col("description")))
    parsed = X.parse_sidecars(broken.withColumn("xml", F.coalesce("xml", F.lit(""))), "xml")
    return parsed.select("path", "pick", F.col("error").isNotNull().alias("failed"))


@query("rewrite_sidecars", f"""
WITH x AS (SELECT doc_id, lang, {_XML} AS xml FROM documents)
SELECT CAST(doc_id AS VARCHAR) || '.ARW' AS path, md5(CASE lang
   WHEN 'de' THEN replace(xml, ' xmp:Rating="1"{_SPACES}>', '{_SPACES} xmp:Rating="-1">')
   WHEN 'fr' THEN replace(xml, ' xmp:Rating="-1"{_SPACES}>', '{_SPACES} xmp:Rating="-1">')
   ELSE replace(xml, '{_SPACES}>', '{_SPACES} xmp:Rating="-1">') END) AS xml, CAST(NULL AS VARCHAR) AS error FROM x
UNION ALL
SELECT CAST(doc_id AS VARCHAR) || '.JPG' AS path, md5({_HEAD} || ' {_XMP} xmp:Rating="-1">' || {_TAIL}) AS xml, CAST(NULL AS VARCHAR) AS error FROM documents""")
def rewrite_sidecars(spark, sf):
    """Every image is rejected; all other bytes of its sidecar stay, in both forms."""
    out = X.rewrite_sidecars(_both_forms(_rendered(spark, sf)), "pick", F.lit("-1"))
    return out.select("path", F.md5("xml").alias("xml"), "error")


@query("rewrite_sidecars_marks", f"""
SELECT CAST(doc_id AS VARCHAR) || '.ARW' AS path, {_HEAD} || ' {_XMP} xmp:Rating="-1">' || {_TAIL} AS xml, CAST(NULL AS VARCHAR) AS error
FROM documents""")
def rewrite_sidecars_marks(spark, sf):
    """The same in sidecars that have no block of keywords and texts."""
    return X.rewrite_sidecars(_marks(spark, sf), "pick", F.lit("-1")).select("path", "xml", "error")


@query("rewrite_sidecars_stable", f"""SELECT CAST(doc_id AS VARCHAR) || '.ARW' AS path, md5({_XML}) AS xml FROM documents""")
def rewrite_sidecars_stable(spark, sf):
    """Writing the same metadata again, twice, gives the same bytes."""
    rows = _rendered(spark, sf)
    block = X.iptc_block(F.col("keywords"), {"description": F.col("description"), "city": F.col("city")})
    once = X.rewrite_sidecars(rows, "iptc", block).select("path", "xml")
    again = once.join(rows.select("path", block.alias("block")), "path")
    return X.rewrite_sidecars(again, "iptc", F.col("block")).select("path", F.md5("xml").alias("xml"))


@query("write_sidecar_files", f"""
SELECT CAST(doc_id AS VARCHAR) || '.ARW' AS file_name, md5({_XML}) AS xml FROM documents
UNION ALL
SELECT CAST(doc_id AS VARCHAR) || '.JPG' AS file_name, md5({_MARKS}) AS xml FROM documents WHERE lang = 'es'""")
def write_sidecar_files_query(spark, sf):
    """Write every document's file and, for Spanish ones, another of marks alone; then read the folder back."""
    folder = shared_folder(spark, "sidecars")
    rows = _both_forms(_rendered(spark, sf), F.col("keywords")[0] == "es").withColumn("path", F.concat(F.lit(f"{folder}/"), "path", F.lit(".xmp")))
    write_sidecar_files(rows, held=True).write.format("noop").mode("overwrite").save()
    # Listed and read by tasks: Spark's file reader would list the folder and plan every file on the driver.
    back = read_files(scan_files(spark, folder).where("path IS NOT NULL").select("path"))
    name = F.regexp_replace(file_name(F.col("path")), r"\.xmp$", "")
    return back.select(name.alias("file_name"), F.md5("content").alias("xml"))


@query("edit_sidecars", r"""
WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g')) AS t, doc_id % 3 > 0 AS had, doc_id % 2 = 0 AS words FROM documents)
SELECT CAST(doc_id AS VARCHAR) || '.ARW' AS file_name, 'Rejected' AS pick,
  CASE WHEN words THEN 'new & ' || source WHEN had THEN lang || '|a&b <' || source ELSE '' END AS keywords,
  CASE WHEN had AND t <> '' THEN md5(t) END AS description, CAST(NULL AS VARCHAR) AS error FROM d""")
def edit_sidecars(spark, sf):
    """Two marks within the pause and, for every other image, keywords: debounced and written into sidecars, two thirds of which are there before."""
    folder = shared_folder(spark, "edited")
    place = F.concat(F.lit(f"{folder}/"), "path")
    rows = _rendered(spark, sf)
    there = rows.where("doc_id % 3 > 0").select(F.concat(place, F.lit(".xmp")).alias("path"), "xml")
    write_sidecar_files(there, held=True).write.format("noop").mode("overwrite").save()
    docs = _state(spark, sf).withColumn("path", place)

    def edit(number, ms, kind, pick, keywords):
        return docs.select(
            (F.col("doc_id") * 3 + number).alias("seq"), F.timestamp_millis(F.lit(ms)).alias("ts"), "path", F.lit(kind).alias("kind"),
            F.lit(pick).cast("string").alias("pick"), keywords.alias("keywords"), F.lit(None).cast("struct<title: string>").alias("fields"))

    none = F.lit(None).cast("array<string>")
    log = edit(0, 0, "mark", "Picked", none).unionByName(edit(1, 500, "mark", "Rejected", none)).unionByName(
        edit(2, 100, "keywords", None, F.array(F.concat(F.lit("new & "), F.element_at(F.split(F.col("keywords")[1], "<"), 2)))).where("seq % 2 = 0"))
    done = shared_folder(spark, "edit-results")
    write_edits(coalesce_edits(log)).write.parquet(done)
    back = X.read_sidecars(spark, folder)
    return back.select(file_name(F.col("path")).alias("file_name"), "pick", F.array_join("keywords", "|").alias("keywords"),
                       F.md5("iptc.description").alias("description"), "error")


@query("load_templates", """
SELECT CAST(p_partkey AS VARCHAR) AS name, 'city' AS field, 'blank city of ' || CAST(p_partkey AS VARCHAR) || ' removes the value it meets' AS warning
FROM part WHERE p_type = 'ECONOMY'""")
def load_templates(spark, sf):
    """The warning rule over a table of template fields."""
    value = F.when(F.col("p_type") == "ECONOMY", " \t").otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("name"), F.lit("city").alias("field"), value.alias("value"))
    return template_warnings(rows)


@query("copy_files", """
SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, 'Copy' AS action, TRUE AS ok, sha256(text) AS src_hash, sha256(text) AS dst_hash,
  'match' AS verdict FROM documents""")
def copy_files_query(spark, sf):
    """Put every text into a file, copy the files, and compare both folders."""
    source, target = shared_folder(spark, "card"), shared_folder(spark, "selects")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    files = docs.select(F.concat(F.lit(f"{source}/"), "name").alias("path"), F.col("text").alias("xml"))
    write_sidecar_files(files).write.format("noop").mode("overwrite").save()
    plan = docs.select(F.col("doc_id").alias("image_id"), F.concat(F.lit(f"{source}/"), "name").alias("src_path"), F.lit(target).alias("dst_folder"),
                       "name", F.lit("Copy").alias("action"), F.lit(None).cast("string").alias("src_sidecar"))
    # The job writes files, so its result rows go to a table before anything reads them twice.
    done = shared_folder(spark, "results")
    copy_files(plan).write.parquet(done)
    results = spark.read.parquet(done)
    a = hash_files(results.select(F.concat(F.lit(f"{source}/"), "name").alias("path"))).withColumn("name", file_name(F.col("path")))
    b = hash_files(results.select(F.concat(F.lit(f"{target}/"), "name").alias("path"))).withColumn("name", file_name(F.col("path")))
    return results.join(P.verify_copies(a, b), "name").select("name", "action", "ok", "src_hash", "dst_hash", "verdict")
