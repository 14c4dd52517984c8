"""Queries over sidecars hold both forms of every document's: with keywords and the whole text, and of marks alone."""

from __future__ import annotations

import hashlib

import oracle

from sievelight.plans import QUERIES

_BARE = """<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="sievelight">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description rdf:about=""{}>
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>
"""
_XMP = 'xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
_BY_LANG = {"de": '\n    xmp:Rating="1"', "fr": '\n    xmp:Rating="-1"', "en": "", "es": ""}


def _langs(spark):
    return {r.doc_id: r.lang for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "lang").collect()}


def _bare_md5(lang: str) -> str:
    return hashlib.md5(_BARE.format(f"\n    {_XMP}{_BY_LANG[lang]}").encode()).hexdigest()


def test_render_gives_both_forms(spark):
    langs = _langs(spark)
    got = QUERIES["render_sidecars"](spark, oracle.SF).collect()
    assert len(got) == len(langs) and {r.doc_id: r.marks for r in got} == {d: _bare_md5(lang) for d, lang in langs.items()}
    assert all(r.xml != r.marks for r in got)


def test_rewrite_takes_both_forms(spark):
    langs = _langs(spark)
    got = QUERIES["rewrite_sidecars"](spark, oracle.SF).collect()
    assert sorted(r.path for r in got) == sorted(f"{d}.{form}" for d in langs for form in ("ARW", "JPG"))
    # The attributes of an edited element stand on one line, whatever the rating was.
    rejected = hashlib.md5(_BARE.format(f' {_XMP} xmp:Rating="-1"').encode()).hexdigest()
    assert {r.xml for r in got if r.path.endswith(".JPG")} == {rejected} and {r.error for r in got} == {None}


def test_files_are_written_in_both_forms(spark):
    langs = _langs(spark)
    got = {r.file_name: r.xml for r in QUERIES["write_sidecar_files"](spark, oracle.SF).collect()}
    spanish = [d for d, lang in langs.items() if lang == "es"]
    assert spanish and set(got) == {f"{d}.ARW" for d in langs} | {f"{d}.JPG" for d in spanish}
    assert all(got[f"{d}.JPG"] == _bare_md5("es") != got[f"{d}.ARW"] for d in spanish)
