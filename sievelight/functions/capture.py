"""Capture-time and camera rules on EXIF text, which has no zone and is never trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.text import bind, name_extension, name_stem, squeeze_spaces, trim_unicode

_SORT_KEY = (r"^(\d{1,9}):(\d{1,9}):(\d{1,9})(?::[^ ]*)? "
             r"(\d{1,9}):(\d{1,9}):(\d{1,9})(?::[^.]*)?(?:\.(\d{0,3}).*)?$")
_UNSET = r"^0000|^\d{4}:00|^\d{4}:\d{2}:00"
_EXIF_TIME = r"^(\d{4}):(\d{2}):(\d{2})(?::[^ ]*)? ([0-9:]+)$"


def sort_key(time: Column, subsec: Column) -> Column:
    """Capture time with exactly three sub-second digits; NULL without a time."""
    digits = F.regexp_replace(F.coalesce(subsec, F.lit("")), "[^0-9]", "")
    # rpad also cuts to three characters, which is wanted here.
    return F.concat(time, F.lit("."), F.rpad(digits, 3, "0"))


def sort_key_ms(key: Column) -> Column:
    """Sort key to milliseconds by calendar arithmetic without range checks.

    Month 13 counts on instead of failing; anything not made of digits is NULL.
    """
    fields = F.split(F.regexp_replace(key, _SORT_KEY, "$1,$2,$3,$4,$5,$6,$7"), ",")

    def count(p: Column) -> Column:
        y, m, d, hour, minute, second = (F.get(p, F.lit(i)).try_cast("bigint") for i in range(6))
        return bind(y - (m <= 2).cast("bigint"), lambda year: (
            (year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)
             + F.floor((153 * ((m + 9) % 12) + 2) / 5) + d - 719469) * 86400
            + hour * 3600 + minute * 60 + second) * 1000 + F.rpad(F.get(p, F.lit(6)), 3, "0").try_cast("bigint"))

    return F.when(key.rlike(_SORT_KEY), bind(fields, count).cast("bigint"))


def capture_context(exif_time: Column, mtime: Column, name: Column, camera: Column) -> Column:
    """Values for template variables: date, time, filename, camera, ext.

    A missing or malformed EXIF time, or one with an unset clock, falls back to
    ``mtime`` in UTC.
    """
    # "date,clock" of a well-formed time, NULL for anything else.
    stamp = bind(trim_unicode(exif_time), lambda t: F.when(
        t.rlike(_EXIF_TIME) & ~t.rlike(_UNSET), F.split(F.regexp_replace(t, _EXIF_TIME, "$1-$2-$3,$4"), ",")))
    stamp = bind(stamp, lambda s: bind(F.replace(s[1], F.lit(":"), F.lit("")), lambda clock: F.when(
        F.length(clock) == 6, F.struct(s[0].alias("date"), clock.alias("time")))))
    # Whole seconds since the epoch, so the session zone plays no part.
    secs = F.greatest(F.coalesce(F.unix_seconds(mtime), F.lit(0)), F.lit(0))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(secs / 86400).cast("int"))
    of_day = secs % 86400
    two = [F.lpad(F.floor(x).cast("string"), 2, "0") for x in (of_day / 3600, of_day / 60 % 60, of_day % 60)]
    fallback = F.struct(day.cast("string").alias("date"), F.concat(*two).alias("time"))
    return bind(F.coalesce(stamp, fallback), lambda at: F.struct(
        at["date"].alias("date"), at["time"].alias("time"),
        name_stem(name).alias("filename"),
        F.coalesce(squeeze_spaces(camera), F.lit("")).alias("camera"),
        F.upper(name_extension(name)).alias("ext"),
    ))


# Layout versions of the enciphered block that hold the sequence fields, the places of
# the fields in it, and its cipher: a byte p below 249 is written as p cubed modulo 249.
SEQUENCE_VERSIONS = (0x23, 0x24, 0x26, 0x28, 0x31, 0x32, 0x33, 0x41, 0x43)
RELEASE_MODE_AT, IMAGE_NUMBER_AT, CIPHER = 0x09, 0x12, 249


def sequence_fields(block: Column) -> Column:
    """Release mode and image number (from 1) of an enciphered block; NULL where its version has none."""
    plain = list(range(256))
    for p in range(CIPHER):
        plain[p ** 3 % CIPHER] = p

    def raw(at: int) -> Column:
        return F.conv(F.hex(F.substring(block, at + 1, 1)), 16, 10).cast("int")

    def byte(at: int) -> Column:
        return F.element_at(F.array(*map(F.lit, plain)), raw(at) + 1)

    number = sum((byte(IMAGE_NUMBER_AT + i).cast("bigint") * (1 << 8 * i) for i in range(1, 4)), byte(IMAGE_NUMBER_AT).cast("bigint"))
    fields = F.struct(byte(RELEASE_MODE_AT).cast("bigint").alias("release_mode"),
                      F.least(number + 1, F.lit(0xFFFFFFFF).cast("bigint")).alias("image_number"))
    return F.when((F.octet_length(block) > IMAGE_NUMBER_AT + 3) & raw(0).isin(*SEQUENCE_VERSIONS), fields)


def burst_seq(release_mode: Column, number: Column) -> Column:
    """Release mode 0 declares a single frame, whatever number it carries."""
    return F.when(release_mode == 0, F.lit(0)).otherwise(number)


def display_dims(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height as shown: orientations 5..8 lie on their side."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(
        F.when(turned, height).otherwise(width).alias("width"),
        F.when(turned, width).otherwise(height).alias("height"),
    )


def valid_orientation(value: Column) -> Column:
    return F.when(value.between(1, 8), value).otherwise(F.lit(1))


def is_joinable(time: Column, seq: Column) -> Column:
    """A frame can join a burst when it has a time and is not a declared single."""
    return time.isNotNull() & (F.coalesce(seq, F.lit(-1)) != 0)


def rating_to_pick(rating: Column) -> Column:
    return F.when(rating < 0, F.lit("Rejected")).when(rating > 0, F.lit("Picked")).otherwise(F.lit("Unmarked"))


def pick_to_rating(pick: Column) -> Column:
    return F.when(pick == "Picked", F.lit(1)).when(pick == "Rejected", F.lit(-1))


def needs_refresh(source_mtime: Column, copied_mtime: Column) -> Column:
    """A source sidecar exists and its copy is missing or older."""
    return source_mtime.isNotNull() & (copied_mtime.isNull() | (source_mtime > copied_mtime))
