"""Decoding text, inside the JVM wherever that can be said with its functions.

Spark's ``decode`` knows ISO-8859-1 and UTF-16 but not windows-1251 or KOI8-R. Every byte maps to
one ISO-8859-1 character, so a ``translate`` of the upper half gives any single-byte charset.
The translation tables come from Python's own codecs. East Asian charsets, in which ASCII is ASCII
and no second byte is a line break, go through Python's codecs in Arrow batches.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Charsets of two-byte units; their files are cut at two-byte line breaks (see sources/lines.py).
WIDE = ("utf-16", "utf-16-le", "utf-16-be")
#: Python's names of charsets whose further bytes are never a line break.
MULTI_BYTE = frozenset((
    "big5", "big5hkscs", "cp932", "cp949", "cp950", "euc_jis_2004", "euc_jisx0213", "euc_jp", "euc_kr", "gb18030", "gb2312",
    "gbk", "johab", "shift_jis", "shift_jis_2004", "shift_jisx0213",
))
SINGLE_BYTE = ("cp1251", "koi8-r", "latin-1")
_UPPER = [chr(b) for b in range(128, 256)]


def canonical(encoding: str) -> str:
    """Python's name for an encoding; ValueError when it is not one this engine reads."""
    try:
        name = codecs.lookup(encoding).name
    except LookupError as e:
        raise ValueError(f"unknown encoding: {encoding}") from e
    if name == "utf-8-sig":
        return name
    if name == "utf-8" or name in WIDE or name in MULTI_BYTE:
        return name
    try:
        decoded = [_decode_byte(b, name) for b in range(256)]
    except (UnicodeError, LookupError) as e:
        raise ValueError(f"not a charset that lines can be cut in: {encoding}") from e
    if any(d is not None and len(d) != 1 for d in decoded) or decoded[:128] != [
        chr(b) for b in range(128)
    ]:
        raise ValueError(f"not an ASCII-based single-byte encoding: {encoding}")
    return name


def _decode_byte(byte: int, encoding: str) -> str | None:
    try:
        return bytes([byte]).decode(encoding)
    except UnicodeDecodeError:
        return None


def _by_codec(raw: Column, encoding: str) -> Column:
    """Text of the bytes, null where they are not valid."""
    def decode(lines: pd.Series) -> pd.Series:
        def one(line):
            try:
                return None if line is None else line.decode(encoding)
            except UnicodeDecodeError:
                return None
        return lines.map(one)

    return F.pandas_udf(decode, "string")(raw.cast("binary"))


def decode_wide(raw: Column, encoding: str) -> Column:
    """Decode the bytes of a line of two-byte units."""
    order = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}[encoding]
    return F.decode(raw.cast("binary"), order)


def _bytes_as_latin(raw: Column) -> Column:
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def decodable(raw: Column, encoding: str) -> Column:
    """Whether the bytes of a line are valid in ``encoding``."""
    name = canonical(encoding)
    if name.startswith("utf-8"):
        return F.is_valid_utf8(raw)
    if name in MULTI_BYTE:
        return _by_codec(raw, name).isNotNull() | raw.isNull()
    holes = "".join(c for b, c in enumerate(_UPPER, 128) if _decode_byte(b, name) is None)
    if not holes:
        return F.lit(True)
    latin = _bytes_as_latin(raw)
    return F.translate(latin, holes, "") == latin


def decode_bytes(raw: Column, encoding: str) -> Column:
    """Decode the bytes of a line that ``decodable`` accepted."""
    name = canonical(encoding)
    if name.startswith("utf-8"):
        return raw.cast("string")
    if name in MULTI_BYTE:
        return _by_codec(raw, name)
    known = [(c, _decode_byte(b, name)) for b, c in enumerate(_UPPER, 128)]
    known = [(c, d) for c, d in known if d is not None and d != c]
    latin = _bytes_as_latin(raw)
    if not known:
        return latin
    return F.translate(latin, "".join(c for c, _ in known), "".join(d for _, d in known))
