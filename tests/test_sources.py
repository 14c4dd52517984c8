from __future__ import annotations

import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from sievelight.functions.text import file_name
from sievelight.operators.copyplan import copy_report, plan_copy, verify_copies
from sievelight.operators.selection import attach_sidecars
from sievelight.sources import files as L
from sievelight.sources import media as J
from sievelight.sources import sidecars as X
from sievelight.sources.template_files import TemplatesFileError, load_templates, save_templates, template_of
from sievelight.sources.transfer import copy_files, hash_files, write_sidecar_files

# -- listings --------------------------------------------------------------------


def test_scan_pairs_and_filters(spark, tmp_path):
    for n in ["DSC001.ARW", "DSC001.JPG", "dsc002.arw", "DSC002.jpeg", "DSC003.JPG", "phone.jpeg", "clip.MP4", "notes.txt", "A 1.nef"]:
        (tmp_path / n).write_bytes(b"x" * 7)
    (tmp_path / "DSC004.ARW").mkdir()
    (tmp_path / "DSC004.JPG").write_bytes(b"")
    found = L.scan_files(spark, str(tmp_path))
    shown = L.hide_paired(L.keep_image_extensions(found)).collect()
    assert sorted(r.file_name for r in shown) == ["A 1.nef", "DSC001.ARW", "DSC003.JPG", "DSC004.JPG", "dsc002.arw", "phone.jpeg"]
    assert {r.size for r in shown} == {0, 7} and {r.status for r in shown} == {"Placeholder"}
    assert {r.session_id.removeprefix("file:") for r in shown} == {str(tmp_path)}


def test_listing_errors_are_rows(spark, tmp_path):
    (tmp_path / "good.ARW").write_bytes(b"1")
    os.symlink(tmp_path / "gone", tmp_path / "broken.ARW")
    os.symlink(tmp_path / "good.ARW", tmp_path / "link.ARW")
    rows = L.scan_files(spark, [str(tmp_path), str(tmp_path / "nowhere")])
    good, failed = L.split_failed(rows)
    assert sorted(r.file_name for r in good.collect()) == ["good.ARW", "link.ARW"]
    assert sorted((r.file_name or "", r.reason.split(":")[0]) for r in failed.collect()) == [
        ("", "folder not listed"), ("broken.ARW", "entry not read")]
    assert good.count() + failed.count() == rows.count()


def test_a_huge_folder_is_many_tasks(spark, tmp_path):
    for i in range(2000):
        (tmp_path / f"{i:05d} é.ARW").write_bytes(b"x" * (i % 7))
    os.symlink(tmp_path / "gone", tmp_path / "broken.ARW")
    for rows in (L.scan_files(spark, [str(tmp_path), str(tmp_path / "none")], shares=5),
                 L.list_folders(spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "none"),)], "folder string"), shares=5, tasks=10)):
        got = rows.withColumn("task", F.spark_partition_id()).collect()
        good = [r for r in got if r.status != "Failed"]
        assert sorted((r.file_name, r.size) for r in good) == [(f"{i:05d} é.ARW", i % 7) for i in range(2000)]
        assert sorted(r.reason.split(":")[0] for r in got if r.status == "Failed") == ["entry not read", "folder not listed"]
        per_task = {}
        for r in good:
            per_task[r.task] = per_task.get(r.task, 0) + 1
        assert len(per_task) >= 3 and max(per_task.values()) < 1400


def test_unreadable_raw_does_not_hide_its_jpeg(spark):
    df = spark.createDataFrame([("s", "a.ARW", "Failed"), ("s", "a.JPG", "Loaded")], "session_id string, file_name string, status string")
    assert L.hide_paired(df).count() == 2
    assert L.hide_paired(df, readable=F.lit(True)).count() == 1
    good, failed = L.split_failed(df)
    assert (good.count(), failed.count()) == (1, 1)


# -- byte jobs ---------------------------------------------------------------------

def tiff(order="<", entries=(), exif=(), extra=b""):
    """A TIFF with IFD0 and, when given, an Exif IFD; values longer than 4 bytes go to the end."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    tables = [list(entries), list(exif)]
    if exif:
        tables[0].append((0x8769, 4, 1, None))
    sizes = [2 + 12 * len(t) + 4 for t in tables]
    tail_at = 8 + sizes[0] + (sizes[1] if exif else 0)
    body, tail = b"", b""
    for t in tables[:2 if exif else 1]:
        body += pack("H", len(t))
        for tag, kind, count, value in t:
            if tag == 0x8769:
                value = pack("I", 8 + sizes[0])
            elif isinstance(value, bytes) and len(value) > 4:
                at, tail = tail_at + len(tail), tail + value
                value = pack("I", at)
            elif isinstance(value, int):
                value = pack("HH", value, 0) if kind == 3 else pack("I", value)
            body += pack("HHI", tag, kind, count) + value.ljust(4, b"\0")
        body += pack("I", 0)
    return (b"II" if order == "<" else b"MM") + pack("HI", 42, 8) + body + tail + extra


def text(tag, value):
    raw = value.encode("latin-1") + b"\0"
    return (tag, 2, len(raw), raw)


EXIF = [text(0x9003, "2021:04:05 17:41:23"), text(0x9291, "57"), text(0xA431, "04470536")]
MAIN = [text(0x010F, "SONY"), text(0x0110, " ILCE-1 "), (0x0112, 3, 1, 6)]


def jpeg(width=64, height=48, app1=b"", end=True):
    sof = b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x00\x00\x00"
    return b"\xff\xd8" + app1 + sof + b"\xff\xda\x00\x04\x00\x00" + b"data\xff\x00data" + (b"\xff\xd9" if end else b"")


def capture_of(spark, tmp_path, files):
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    rows = J.extract_capture_metadata(L.scan_files(spark, str(tmp_path))).collect()
    return {os.path.basename(r.path): r for r in rows}


def test_capture_metadata(spark, tmp_path):
    app1 = tiff("<", MAIN, EXIF)
    block = b"\xff\xe1" + struct.pack(">H", len(app1) + 8) + b"Exif\0\0" + app1
    got = capture_of(spark, tmp_path, {
        "le.ARW": tiff("<", MAIN, EXIF), "be.ARW": tiff(">", MAIN, EXIF), "bare.ARW": tiff("<", []),
        "cut.ARW": tiff("<", MAIN, EXIF)[:70], "odd.ARW": tiff("<", [(0x0112, 3, 1, 9), (0x010F, 7, 5, b"SONY\0")]),
        "junk.ARW": b"no image", "empty.ARW": b"", "a.JPG": jpeg(app1=block), "b.jpg": jpeg(), "c.jpg": b"not a jpeg",
        "hostile.ARW": b"II*\0\x08\0\0\0" + b"\xff" * 40, "big.ARW": tiff("<", [(0x010F, 2, 2000, b"x" * 2000)])})
    for n in ("le.ARW", "be.ARW"):
        r = got[n]
        assert (r.make, r.model, r.serial, r.capture_time, r.subsec, r.orientation, r.error) == (
            "Sony", "ILCE-1", "04470536", "2021:04:05 17:41:23", "57", 6, None)
    assert got["a.JPG"].make == "SONY" and got["a.JPG"].capture_time and got["a.JPG"].sequence_number is None
    for n in ("bare.ARW", "odd.ARW", "b.jpg", "c.jpg", "hostile.ARW", "big.ARW"):
        assert (got[n].make, got[n].capture_time, got[n].orientation, got[n].error) == (None, None, 1, None), n
    assert got["cut.ARW"].error is None and got["cut.ARW"].capture_time is None
    assert got["junk.ARW"].error and got["empty.ARW"].error
    assert len(got) == 12


def test_missing_file_is_a_row(spark, tmp_path):
    df = spark.createDataFrame([(str(tmp_path / "gone.ARW"),), (str(tmp_path / "here.ARW"),)], "path string")
    (tmp_path / "here.ARW").write_bytes(tiff("<", MAIN, EXIF))
    got = {os.path.basename(r.path): r.error for r in J.extract_capture_metadata(df).collect()}
    assert got["here.ARW"] is None and "not read" in got["gone.ARW"]


def test_previews_and_audit(spark, tmp_path):
    good, cut = jpeg(800, 600), jpeg(640, 480, end=False)

    def raw(pointers, payload):
        base = tiff("<", [(0x0201, 4, 1, 0), (0x0202, 4, 1, 0)])
        entries = [(0x0201, 4, 1, len(base)), (0x0202, 4, 1, pointers)]
        return tiff("<", entries) + payload

    (tmp_path / "good.ARW").write_bytes(raw(len(good), good))
    (tmp_path / "cut.ARW").write_bytes(raw(len(cut), cut))
    (tmp_path / "outside.ARW").write_bytes(raw(len(good) + 1, good))
    (tmp_path / "nojpeg.ARW").write_bytes(raw(20, b"x" * 20))
    (tmp_path / "whole.jpg").write_bytes(good)
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    # A long stream: the end marker lies many blocks behind the scan header.
    (tmp_path / "long.jpg").write_bytes(good[:-2] + b"\0" * 300_000 + b"\xff\xd9" + b"\0" * 70_000)
    rows, errors = J.index_previews(L.scan_files(spark, str(tmp_path)))
    got = {os.path.basename(r.path): r for r in rows.collect()}
    assert set(got) == {"good.ARW", "cut.ARW", "whole.jpg", "long.jpg"}
    assert (got["good.ARW"].width, got["good.ARW"].height, got["good.ARW"].whole_file) == (800, 600, False)
    assert got["whole.jpg"].whole_file and got["whole.jpg"].len == len(good)
    assert [os.path.basename(r.path) for r in errors.collect()] == ["broken.jpg"]
    audit = {os.path.basename(r.path): (r.truncated, r.implausible) for r in J.audit_jpegs(rows).collect()}
    assert audit == {"good.ARW": (False, False), "cut.ARW": (True, False), "whole.jpg": (False, False), "long.jpg": (False, False)}


def test_duplicate_offsets_and_loops_end(spark, tmp_path):
    # IFD0 points to itself as the next table; two sub tables name one JPEG.
    pic = jpeg()
    base = 8 + 2 + 3 * 12 + 4
    sub = lambda: struct.pack("<H", 2) + struct.pack("<HHII", 0x0201, 4, 1, base + 60 + 8) + struct.pack("<HHII", 0x0202, 4, 1, len(pic)) + struct.pack("<I", 8)
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + struct.pack("<HHHHI", 0x0112, 3, 1, 0, 8) + \
        struct.pack("<HHII", 0x014A, 4, 2, base + 60) + struct.pack("<HHII", 0x0100, 4, 1, 5) + struct.pack("<I", 8)
    data = head + sub() + sub() + struct.pack("<II", base, base + 30) + pic
    (tmp_path / "x.ARW").write_bytes(data)
    rows, _ = J.index_previews(L.scan_files(spark, str(tmp_path)))
    assert [(r.offset, r.width) for r in rows.collect()] == [(base + 68, 64)]


# -- sidecars -----------------------------------------------------------------------

GOLDEN = """<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="sievelight">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description rdf:about=""
    xmlns:xmp="http://ns.adobe.com/xap/1.0/"{rating}>
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>
"""


def fresh(spark, pick="Unmarked"):
    return spark.range(1).select(X.render_sidecar(F.lit(pick)).alias("x")).first().x


def test_fresh_sidecars(spark):
    for pick, rating in (("Picked", '\n    xmp:Rating="1"'), ("Rejected", '\n    xmp:Rating="-1"'), ("Unmarked", "")):
        assert fresh(spark, pick) == GOLDEN.format(rating=rating)


def parse(spark, *docs):
    df = spark.createDataFrame([(i, d if isinstance(d, bytes) else d.encode()) for i, d in enumerate(docs)], "path int, content binary")
    df = df.withColumn("path", F.col("path").cast("string"))
    return X.parse_sidecars(df).orderBy(F.col("path").cast("int")).collect()


def rdf(body, attrs=""):
    return f'<x xmlns:rdf="r" xmlns:dc="d" xmlns:xmp="x" xmlns:photoshop="p"><rdf:Description {attrs}>{body}</rdf:Description></x>'


def test_parse_forms(spark):
    rows = parse(
        spark,
        rdf("", 'xmp:Rating=" 3 " photoshop:City=" Rome "'),
        rdf("<xmp:Rating>-1</xmp:Rating><dc:title><rdf:Alt><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Alt></dc:title>"),
        rdf("<photoshop:City/><other>not a city</other><photoshop:Headline>h</photoshop:Headline>"),
        rdf("<dc:subject><rdf:Bag><rdf:li> a&amp;b </rdf:li><rdf:li/><rdf:li>é|x</rdf:li></rdf:Bag></dc:subject>"),
        rdf("<xmp:Rating>x</xmp:Rating>", 'xmp:Rating="1"') ,
        '<x xmlns:rdf="r" xmlns:xmp="x"><rdf:Description xmp:Rating="1"/><rdf:Description xmp:Rating="-1"/></x>',
        "<not xml at all", "<a/>junk", "", b"<a>\xff</a>", '<!DOCTYPE a [<!ENTITY e "v">]><a>&nope;</a>',
        rdf(f"<dc:description>{'long text ' * 5000}</dc:description>"))
    assert (rows[0].pick, rows[0].iptc.city) == ("Picked", "Rome")
    assert (rows[1].pick, rows[1].iptc.title) == ("Rejected", "one")
    assert (rows[2].iptc.city, rows[2].iptc.headline) == (None, "h")
    assert rows[3].keywords == ["a&b", "é|x"]
    assert (rows[4].pick, rows[5].pick) == ("Picked", "Rejected")
    assert all(r.error and r.pick is None and r.keywords is None for r in rows[6:11])
    assert rows[11].iptc.description == ("long text " * 5000).strip()


# The five characters XML reserves, text beyond one UTF-16 unit, a long list, a long word and one that looks like markup.
KEYWORDS = [["<>&'" + '"'], ["naïve", "жук", "𝄞 clef"], [str(n * n) for n in range(150)], ["w" * 5000], ["<rdf:li>x</rdf:li>", "]]>", "&#38;"], []]


def test_render_read_round_trip(spark):
    df = spark.createDataFrame([(str(i), k, "t & <b>", None) for i, k in enumerate(KEYWORDS)],
                               "path string, kw array<string>, title string, city string")
    xml = X.render_sidecar(F.lit("Picked"), F.col("kw"), {"title": F.col("title"), "city": F.col("city")})
    rows = X.parse_sidecars(df.withColumn("xml", xml), "xml").orderBy("path").collect()
    assert [r.keywords for r in rows] == KEYWORDS
    assert all((r.pick, r.iptc.title, r.iptc.city, r.error) == ("Picked", "t & <b>", None, None) for r in rows)


def test_rewrite_keeps_foreign_and_is_stable(spark):
    doc = ('<?xpacket begin=""?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF xmlns:rdf="r">\n'
           '  <rdf:Description rdf:about="" xmlns:dcx="d" xmlns:acme="a" acme:keep="1">\n'
           '   <!-- <dc:subject>comment</dc:subject> -->\n   <acme:thing a="x>y"><![CDATA[<dc:title/>]]></acme:thing>\n'
           '   <dcx:subject><rdf:Bag><rdf:li>old</rdf:li></rdf:Bag></dcx:subject>\n'
           '  </rdf:Description>\n  <rdf:Description xmlns:xmp="x" xmp:Rating="5"/>\n </rdf:RDF>\n</x:xmpmeta>\n')
    picked = X.edit_sidecar(doc, "pick", "-1")
    assert picked.count("xmp:Rating") == 1 and 'xmp:Rating="-1"' in picked and 'acme:keep="1"' in picked
    assert X.edit_sidecar(picked, "pick", "") .count("Rating") == 0
    bags = "\n   <dc:subject>\n    <rdf:Bag>\n     <rdf:li>new</rdf:li>\n    </rdf:Bag>\n   </dc:subject>"
    once = X.edit_sidecar(doc, "keywords", bags)
    assert once.count("old") == 0 and once.count("new") == 1 and "<![CDATA[<dc:title/>]]>" in once and "comment" in once
    again = X.edit_sidecar(once, "keywords", bags)
    assert again == once == X.edit_sidecar(again, "keywords", bags)
    assert X.edit_sidecar(once, "keywords", "").count("subject") == 2  # only the comment is left
    assert 'a="x>y"' in once
    compact = rdf("", 'photoshop:City="Rome" acme="1"').replace("></rdf:Description>", "/>")
    out = X.edit_sidecar(compact, "iptc", "\n   <photoshop:City>Oslo</photoshop:City>")
    assert "Rome" not in out and "Oslo" in out and 'acme="1"' in out
    assert "Oslo" not in X.edit_sidecar(out, "iptc", "")


@pytest.mark.parametrize("doc,reason", [("<a/>", "rdf:Description"), ("", "malformed XML"), ("<a", "malformed XML"), (b"\xff", "UTF-8")])
def test_rewrite_refuses(spark, doc, reason):
    df = spark.createDataFrame([("p", doc if isinstance(doc, bytes) else doc.encode())], "path string, xml binary")
    r = X.rewrite_sidecars(df, "pick", F.lit("1")).first()
    assert r.xml is None and reason in r.error


def test_written_sidecars_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/a b.ARW", "Picked"), (f"{tmp_path}/é.ARW", "Rejected"), (f"{tmp_path}/none.ARW", None)], "path string, pick string")
    out = rows.where("pick is not null").select(F.concat("path", F.lit(".xmp")).alias("path"), X.render_sidecar(F.col("pick")).alias("xml"))
    assert {r.ok for r in write_sidecar_files(out).collect()} == {True}
    assert not [n for n in os.listdir(tmp_path) if ".part-" in n]
    cars = X.read_sidecars(spark, str(tmp_path))
    got = attach_sidecars(rows.select("path"), cars.select("path", "pick", "keywords"), ["path"])
    assert sorted((file, pick) for file, pick in got.select(file_name(F.col("path")), "pick").collect()) == [
        ("a b.ARW", "Picked"), ("none.ARW", "Unmarked"), ("é.ARW", "Rejected")]
    (tmp_path / "file").write_text("x")
    bad = spark.createDataFrame([(f"{tmp_path}/file/x.xmp", "<a/>"), (f"{tmp_path}/ok.xmp", "<a/>")], "path string, xml string")
    assert sorted((r.ok, r.reason is None) for r in write_sidecar_files(bad).collect()) == [(False, False), (True, True)]


# -- copies --------------------------------------------------------------------------

def test_copy_job(spark, tmp_path):
    card, out = tmp_path / "card", tmp_path / "out"
    card.mkdir(), out.mkdir()
    for n in ("a.ARW", "b.ARW"):
        (card / n).write_bytes(n.encode() * 1000)
    (card / "a.ARW.xmp").write_text("<x/>")
    (out / "a.ARW").write_bytes(b"other")
    rows = [(i, "s", str(out), n, 1, None) for i, n in enumerate(["a.ARW", "b.ARW", "gone.ARW"])]
    src = spark.createDataFrame(rows, "image_id int, session_id string, dest string, file_name string, size long, src_sidecar_mtime timestamp")
    there = spark.createDataFrame([(str(out), "a.ARW", 5, None)], "dest string, name string, size long, sidecar_mtime timestamp")
    plan = plan_copy(src, there, order=["image_id"]).select(
        "image_id", F.concat(F.lit(f"{card}/"), "file_name").alias("src_path"), F.col("dest").alias("dst_folder"), "name", "action",
        F.when(F.col("image_id") == 0, F.lit(f"{card}/a.ARW.xmp")).alias("src_sidecar"))
    done = spark.createDataFrame(copy_files(plan).collect(), "image_id int, name string, action string, ok boolean, reason string, src_hash string, dst_hash string")
    got = {r.image_id: r for r in done.collect()}
    assert (got[0].name, got[0].ok, got[1].ok, got[2].ok) == ("a_2.ARW", True, True, False)
    assert got[1].src_hash == got[1].dst_hash == hashlib.sha256(b"b.ARW" * 1000).hexdigest()
    assert sorted(os.listdir(out)) == ["a.ARW", "a_2.ARW", "a_2.ARW.xmp", "b.ARW"]
    assert (out / "a.ARW").read_bytes() == b"other"
    report = copy_report(done).first()
    assert (report.copied, report.failed, report.verified) == (2, 1, False)
    # A second run of the same task ends in the same files.
    copy_files(plan).collect()
    assert sorted(os.listdir(out)) == ["a.ARW", "a_2.ARW", "a_2.ARW.xmp", "b.ARW"]


def test_bad_rows_stay_rows(spark, tmp_path):
    (tmp_path / "a.ARW").write_bytes(b"a")
    bad = spark.createDataFrame([("nowhere://h/x.xmp", "<a/>"), (f"{tmp_path}/n.xmp", None), (f"{tmp_path}/ok.xmp", "<a/>")], "path string, xml string")
    wrote = {r.path.rpartition("/")[2]: (r.ok, r.reason) for r in write_sidecar_files(bad).collect()}
    assert wrote["ok.xmp"] == (True, None) and not wrote["x.xmp"][0] and "no text" in wrote["n.xmp"][1]
    assert sorted(os.listdir(tmp_path)) == ["a.ARW", "ok.xmp"]
    hashed = hash_files(spark.createDataFrame([("nowhere://h/x",), (f"{tmp_path}/gone",), (None,), (f"{tmp_path}/a.ARW",)], "path string")).collect()
    assert sum(r.error is not None and r.hash is None for r in hashed) == 3
    facts = J.extract_capture_metadata(spark.createDataFrame([("nowhere://h/x.ARW",), (f"{tmp_path}/a.ARW",)], "path string")).collect()
    assert all(r.error for r in facts)
    listed = L.scan_files(spark, ["nowhere://h/", str(tmp_path)])
    assert sorted((r.status, r.file_name or "") for r in listed.collect()) == [("Failed", ""), ("Placeholder", "a.ARW"), ("Placeholder", "ok.xmp")]
    (tmp_path / "e.ARW.xmp").write_bytes(b"")
    cars = {r.path: r.error for r in X.read_sidecars(spark, str(tmp_path)).collect()}
    assert cars[f"{tmp_path}/ok"] is None and "malformed" in cars[f"{tmp_path}/e.ARW"]


def test_unreadable_copies_never_match(spark):
    side = spark.createDataFrame([("x", None, None, "gone"), ("y", 1, "h", None)], "name string, size long, hash string, error string")
    assert {r.name: r.verdict for r in verify_copies(side, side).collect()} == {"x": "unreadable", "y": "match"}


def test_refused_rows_touch_no_file(spark, tmp_path):
    card, out = tmp_path / "card", tmp_path / "out"
    card.mkdir(), out.mkdir()
    (card / "f").write_text("f")
    rows = [(i, "s", str(out), n, 1, None) for i, n in enumerate(["d.ARW", "d.ARW", "../up.ARW", "ok.ARW"])]
    src = spark.createDataFrame(rows, "image_id int, session_id string, dest string, file_name string, size long, src_sidecar_mtime timestamp")
    there = spark.createDataFrame([(str(out), "d.ARW", 5, None)], "dest string, name string, size long, sidecar_mtime timestamp")
    plan = plan_copy(src, there, order=["image_id"]).select(
        "image_id", F.lit(f"{card}/f").alias("src_path"), F.col("dest").alias("dst_folder"), "name", "action", "refused",
        F.lit(None).cast("string").alias("src_sidecar"))
    assert plan.count() == 4
    got = {r.image_id: (r.ok, r.reason) for r in copy_files(plan).collect()}
    assert got == {0: (False, "several sources take this name"), 1: (False, "several sources take this name"),
                   2: (False, "the name leaves the destination"), 3: (True, None)}
    assert os.listdir(out) == ["ok.ARW"] and sorted(os.listdir(tmp_path)) == ["card", "out"]


def test_verify_finds_changes(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    for n in ("same", "bad", "lost"):
        (a / n).write_text(n)
    for n, t in (("same", "same"), ("bad", "b4d"), ("more", "m")):
        (b / n).write_text(t)
    side = lambda d: hash_files(L.scan_files(spark, str(d))).withColumn("name", file_name(F.col("path")))
    assert {r.name: r.verdict for r in verify_copies(side(a), side(b)).collect()} == {
        "same": "match", "bad": "mismatch", "lost": "missing", "more": "extra"}


# -- templates ------------------------------------------------------------------------

def test_templates_file(spark, tmp_path):
    path = str(tmp_path / "t.toml")
    assert [d.count() for d in load_templates(spark, path)] == [0, 0, 0]
    (tmp_path / "t.toml").write_text('[templates.good]\ncity = "Rome"\nheadline = " "\nkeywords = ["a", "{date}"]\n[templates.bad]\ncity = 5\n')
    templates, errors, warnings = load_templates(spark, path)
    assert template_of(templates, "good") == ({"city": "Rome", "headline": " "}, ["a", "{date}"])
    assert [r.name for r in errors.collect()] == ["bad"] and [r.field for r in warnings.collect()] == ["headline"]
    save_templates(path, {'q"x': {"title": 'a"b\\c\n', "keywords": ["k"]}})
    assert template_of(load_templates(spark, path)[0], 'q"x') == ({"title": 'a"b\\c\n'}, ["k"])
    (tmp_path / "t.toml").write_text("not toml [")
    with pytest.raises(TemplatesFileError):
        load_templates(spark, path)
