"""RAW-shaped bytes built from table rows with Column expressions, for the byte jobs.

Layout (little-endian, offsets fixed): header 0, IFD0 8, its texts 62, Exif IFD
86, its texts 140, maker note 172, enciphered block 190, IFD1 222 (a preview
with dimensions), IFD2 276 (a preview without), then the two JPEG streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_JPEG, SECOND_JPEG, FILE_SIZE = 306, 320, 348


def _little(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), size * 2, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def _text(value: Column, size: int) -> Column:
    return F.hex(F.rpad(value, size, "\0"))


def _entry(tag: int, kind: int, count: int, value: Column) -> Column:
    head = tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + count.to_bytes(4, "little")
    return F.concat(F.lit(head.hex()), value)


def _ifd(entries: list[Column], after: int) -> Column:
    return F.concat(F.lit(len(entries).to_bytes(2, "little").hex()), *entries, F.lit(after.to_bytes(4, "little").hex()))


def _cipher(byte: Column) -> Column:
    return _little(byte * byte * byte % 249, 1)


def raw_file(make: Column, model: Column, orientation: Column, time: Column, subsec: Column, serial: Column,
             release_mode: Column, image_number: Column, width: Column, height: Column, complete: Column) -> Column:
    at = lambda n: _little(F.lit(n), 4)
    dims = F.concat(F.lpad(F.hex(height.cast("bigint")), 4, "0"), F.lpad(F.hex(width.cast("bigint")), 4, "0"))
    ending = F.when(complete, "FFD9").otherwise("0000")
    parts = [
        F.lit("49492A0008000000"),
        _ifd([_entry(0x010F, 2, 8, at(62)), _entry(0x0110, 2, 16, at(70)),
              _entry(0x0112, 3, 1, F.concat(_little(orientation, 2), F.lit("0000"))), _entry(0x8769, 4, 1, at(86))], 222),
        _text(make, 8), _text(model, 16),
        _ifd([_entry(0x9003, 2, 20, at(140)), _entry(0x9291, 2, 4, _text(subsec, 4)),
              _entry(0x927C, 7, 50, at(172)), _entry(0xA431, 2, 12, at(160))], 0),
        _text(time, 20), _text(serial, 12),
        _ifd([_entry(0x9400, 7, 32, at(190))], 0),
        # Version byte, 8 free bytes, release mode, 8 free bytes, image number, 10 free bytes.
        F.lit("31" + "00" * 8), _cipher(release_mode), F.lit("00" * 8), _cipher(image_number), F.lit("00" * 3),
        F.lit("00" * 10),
        _ifd([_entry(0x0100, 4, 1, _little(width, 4)), _entry(0x0101, 4, 1, _little(height, 4)),
              _entry(0x0201, 4, 1, at(FIRST_JPEG)), _entry(0x0202, 4, 1, at(14))], 276),
        _ifd([_entry(0x0201, 4, 1, at(SECOND_JPEG)), _entry(0x0202, 4, 1, at(28))], 0),
        F.lit("FFD8FFDA0004000001020304"), ending,
        F.lit("FFD8FFC0000B08"), dims, F.lit("01000000FFDA000400000506070800"), F.lit("FFD9"),
    ]
    return F.unhex(F.concat(*parts))
