from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from sievelight.functions import capture as C
from sievelight.functions import text as X
from sievelight.functions.templates import (
    BadSeqWidth, UnclosedBrace, UnknownVariable, expand_template, template_pieces,
)


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_sort_key(spark):
    df = spark.createDataFrame([("2021:04:05 17:41:23", s) for s in (None, "5", "57", "5712", "x?")], "t string, s string")
    got = [r[0][-4:] for r in df.select(C.sort_key(F.col("t"), F.col("s"))).collect()]
    assert got == [".000", ".500", ".570", ".571", ".000"]


def test_sort_key_ms_takes_odd_dates_and_refuses_text(spark):
    good = "2021:04:05 17:41:23.570"
    got = column(spark, [good, "2021:13:05 00:00:00", "2022:01:05 00:00:00", "1600:02:29 00:00:00.1", "x", "", None,
                         "2021:04:05", "1,2,3,4,5,6,7", "2021:04:05 17:41", "+5:1:1 1:1:1"], C.sort_key_ms)
    assert got[0] == 1617644483570
    assert got[1] == got[2] and got[3] is not None
    assert got[4:] == [None] * 7


def test_context_falls_back_to_mtime(spark):
    rows = ["2026:07:25 17:41:23", " 2026:07:25 17:41:23\t", "0000:00:00 00:00:00", "2026:00:25 17:41:23", "2026:07:25", "2026:7:25 17:41:23",
            "2026:13:25 99:99:99", "2026:07:25 17:41:2x", None, "2026:07:25 174123"]
    mtime = F.timestamp_micros(F.lit(86_400_000_000 + 3_661_000_000))
    got = column(spark, rows, lambda c: C.capture_context(c, mtime, F.lit("a.b.arw"), F.lit("  X\t Y ")))
    real, back = ("2026-07-25", "174123"), ("1970-01-02", "010101")
    assert [(r.date, r.time) for r in got] == [real, real, back, back, back, back, ("2026-13-25", "999999"), back, back, real]
    assert (got[0].filename, got[0].ext, got[0].camera) == ("a.b", "ARW", "X Y")


def test_context_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        ctx = C.capture_context(F.lit(None).cast("string"), F.timestamp_micros(F.lit(0)), F.lit("a"), F.lit(None).cast("string"))
        r = spark.range(1).select(ctx.alias("c")).first().c
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r.date, r.time, r.ext, r.camera) == ("1970-01-01", "000000", "", "")


NAMES = ["a.ARW", "a.b.ARW", ".bashrc", "noext", "a.", ".a.b", "a\n.x"]


def test_split_and_suffix(spark):
    got = column(spark, NAMES, X.split_name)
    assert [(r.stem, r.extension) for r in got] == [
        ("a", "ARW"), ("a.b", "ARW"), (".bashrc", ""), ("noext", ""), ("a", ""), (".a", "b"), ("a\n", "x")]
    got = column(spark, NAMES, lambda c: X.suffixed_name(c, F.lit("2")))
    assert got == ["a_2.ARW", "a.b_2.ARW", ".bashrc_2", "noext_2", "a_2.", ".a_2.b", "a\n_2.x"]


WORDS = ["Straße", "STRASSE", "ﬁle", "ΟΔΟΣ", "οδος", "É", "É", "ǰ", "İ", "plain", "ẞ", "ẞ x", "Ꭰ", None, ""]


def test_casefold_and_nfc_equal_python(spark):
    assert column(spark, WORDS, X.casefold) == [None if w is None else w.casefold() for w in WORDS]
    assert column(spark, WORDS, X.nfc) == [None if w is None else unicodedata.normalize("NFC", w) for w in WORDS]


def test_casefold_by_lower_is_exact_below_combining_marks(spark):
    chars = [chr(c) for c in range(1, 0x300)]
    assert column(spark, chars, X.casefold) == [c.casefold() for c in chars]
    assert column(spark, chars, X.nfc) == [unicodedata.normalize("NFC", c) for c in chars]


def test_sanitize_and_escape(spark):
    raw = ["  a\u0007b ", " x　", "é", "\u0085", "a&b<c>\u0000"]
    assert column(spark, raw, X.sanitize_text) == ["ab", "x", "é", "", "a&b<c>"]
    assert column(spark, raw[-1:], X.xml_escape) == ["a&amp;b&lt;c&gt;"]


def test_ascii_lower_leaves_accents(spark):
    assert column(spark, ["ÉA"], X.ascii_lower) == ["Éa"]


def test_guard(spark):
    df = spark.createDataFrame([("/a/b", "/a/b/"), ("/a/b", "/a//b/./c"), ("/a/b", "/a/bc"), ("/a/b", "/a"), ("/", "/x")], "s string, d string")
    got = [r[0] for r in df.select(X.inside_folder(F.col("s"), F.col("d"))).collect()]
    assert "one folder" in got[0] and "below" in got[1] and got[2] is got[3] is None and got[4]
    ups = [("/card", "/x/../card/out"), ("file:///card", "/card/a"), ("/card", "/card/../out"), ("/card/./a/..", "/card")]
    df = spark.createDataFrame(ups, "s string, d string")
    assert [bool(r[0]) for r in df.select(X.inside_folder(F.col("s"), F.col("d"))).collect()] == [True, True, False, True]
    names = ["a.ARW", "../a", "a/../../b", "/etc/x", "file:/x", "a..b", "d/e.ARW", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(X.leaves_folder(F.col("n"))).collect()] == [False, True, True, True, True, False, False, False]


def expand(spark, text, seq=7, n=120):
    ctx = F.struct(*[F.lit(v).alias(k) for k, v in
                     {"date": "2026-07-25", "time": "174123", "filename": "{date}", "camera": "ILCE-1", "ext": "ARW"}.items()])
    return spark.range(1).select(expand_template(text, ctx, F.lit(seq), F.lit(n)).alias("x")).first().x


def test_expand(spark):
    assert expand(spark, "{date}_{time}_{camera}.{ext}") == "2026-07-25_174123_ILCE-1.ARW"
    assert expand(spark, "{seq}|{seq:5}|{seq:1}", 1234, 9) == "1234|01234|1234"
    assert expand(spark, "{seq}") == "007"
    assert expand(spark, "{{x}} } }} {filename}") == "{x} } } {date}"
    assert expand(spark, "") == ""


@pytest.mark.parametrize("text,error", [
    ("{nope}", UnknownVariable), ("{}", UnknownVariable), ("{a{b}", UnknownVariable), ("x{date", UnclosedBrace),
    ("{seq:0}", BadSeqWidth), ("{seq:99}", BadSeqWidth), ("{seq:x}", BadSeqWidth), ("{seq:}", BadSeqWidth)])
def test_template_errors_before_any_row(text, error):
    with pytest.raises(error):
        template_pieces(text)


def test_marks_and_dims(spark):
    assert column(spark, [-3, 0, 5], C.rating_to_pick, "int") == ["Rejected", "Unmarked", "Picked"]
    assert column(spark, ["Picked", "Rejected", "Unmarked"], C.pick_to_rating) == [1, -1, None]
    got = column(spark, [0, 1, 5, 8, 9, None], lambda o: C.display_dims(F.lit(3), F.lit(2), C.valid_orientation(o)), "int")
    assert [(r.width, r.height) for r in got] == [(3, 2), (3, 2), (2, 3), (2, 3), (3, 2), (3, 2)]
    assert column(spark, ["SONY", "sony", "Canon"], X.normalize_make) == ["Sony", "Sony", "Canon"]


def test_keywords_text(spark):
    assert column(spark, [" a, ,b ,, c d "], X.keyword_split) == [["a", "b", "c d"]]
    got = column(spark, [[None, " ", " x "], [], ["\t"]], X.first_value_wins, "array<string>")
    assert got == ["x", None, None]
