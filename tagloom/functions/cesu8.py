"""Modified UTF-8: text as class files and tagged documents spell it.

It is UTF-8, but U+0000 is C0 80, and a character beyond U+FFFF is a pair of
surrogates of three bytes each.  Each text has exactly one spelling.  Column functions
stay in the JVM; only decoding spellings that differ from UTF-8 needs Python.

Sort by the BINARY spelling for the order of the encoded bytes: STRING order puts
U+0000 first and U+10000 last, the spelling does neither.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.errors import DocumentError

_APART = re.compile(b"[\x00\xf0-\xff]")
_ODD = re.compile("[\x00\U00010000-\U0010ffff]")
#: A character that is spelled otherwise than in UTF-8, for Spark's and DuckDB's engines.
ODD = r"[\x{0}\x{10000}-\x{10FFFF}]"


def decode(data: bytes) -> str:
    """The text; DocumentError unless data is its one spelling."""
    try:
        if _APART.search(data):
            raise UnicodeError
        try:
            return data.decode()
        except UnicodeDecodeError:
            # surrogates come out one by one; joined pairs pass, single ones and
            # pairs spelled otherwise do not survive the way through UTF-16
            halves = data.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
            return halves.encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeError:
        raise DocumentError("InvalidUtf8") from None


def encode(text: str) -> bytes:
    if not _ODD.search(text):
        return text.encode()
    units = text.encode("utf-16-le")
    halves = "".join(map(chr, memoryview(units).cast("H")))
    return halves.encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")


def valid(data: bytes) -> bool:
    try:
        decode(data)
    except DocumentError:
        return False
    return True


def needs_encoding(text: Column) -> Column:
    """Whether the spelling differs from UTF-8."""
    return text.rlike(ODD)


def cesu8_encode(text: Column) -> Column:
    """The spelling, BINARY.  Only runs of odd characters are respelled; what stands
    between them is taken whole."""
    def three(unit: Column) -> Column:
        at = F.conv(unit, 16, 10).cast("int")
        high, mid, low = F.shiftright(at, 12), F.shiftright(at, 6).bitwiseAND(F.lit(63)), at.bitwiseAND(F.lit(63))
        return F.concat(F.hex(high + 0xE0), F.hex(mid + 0x80), F.hex(low + 0x80))

    def spelled(c: Column) -> Column:
        units = F.hex(F.encode(c, "UTF-16BE"))
        return (
            F.when(units == "0000", "C080")
            .when(F.length(units) == 8, F.concat(three(F.substring(units, 1, 4)), three(F.substring(units, 5, 4))))
            .otherwise(F.hex(F.encode(c, "UTF-8")))
        )

    def joined(piece: Column, run: Column) -> Column:
        odd = F.array_join(F.transform(F.split(run, ""), spelled), "")
        return F.concat(F.hex(F.encode(piece, "UTF-8")), F.coalesce(odd, F.lit("")))

    # one piece more than runs, so the last piece meets null
    pieces, runs = F.split(text, f"{ODD}+"), F.regexp_extract_all(text, F.lit(f"{ODD}+"), 0)
    respelled = F.unhex(F.array_join(F.zip_with(pieces, runs, joined), ""))
    return F.when(needs_encoding(text), respelled).otherwise(F.encode(text, "UTF-8"))


def cesu8_length(text: Column) -> Column:
    """Bytes of the spelling, by counting: 1 more for a NUL, 2 for a pair."""
    odd = F.regexp_replace(text, r"[^\x{0}\x{10000}-\x{10FFFF}]", "")
    pairs = F.length(F.replace(odd, F.lit("\0"), F.lit("")))
    return F.octet_length(text) + F.length(odd) + pairs


def try_from_str(text: Column) -> Column:
    """The UTF-8 bytes if they are the spelling too, else null."""
    return F.when(~needs_encoding(text), F.encode(text, "UTF-8"))


def push_str(buffer: Column, text: Column) -> Column:
    return F.concat(buffer, cesu8_encode(text))


def _plain(data: Column) -> Column:
    """Whether the bytes are UTF-8 without NUL and four-byte characters."""
    return F.coalesce(F.is_valid_utf8(data.cast("string")) & ~data.cast("string").rlike(ODD), F.lit(False))


def _apply(function, kind: str):
    @F.arrow_udf(kind)
    def applied(column: pa.Array) -> pa.Array:
        def one(data: bytes | None):
            if data is None:
                return None
            try:
                return function(data)
            except DocumentError:
                return None

        return pa.array([one(x) for x in column.to_pylist()], {"string": pa.string(), "boolean": pa.bool_()}[kind])

    return applied


def cesu8_decode(data: Column) -> Column:
    """The text, or null if data is no spelling.  Python sees only what is not UTF-8 as well."""
    plain = _plain(data)
    return F.coalesce(F.when(plain, data.cast("string")), _apply(decode, "string")(F.when(~plain, data)))


def is_cesu8(data: Column) -> Column:
    plain = _plain(data)
    return F.when(plain, F.lit(True)).otherwise(_apply(valid, "boolean")(F.when(~plain, data)))


def try_decode(data: Column) -> Column:
    """The text if its spelling is UTF-8 as well, else null; JVM only."""
    return F.when(_plain(data), data.cast("string"))


def chars(text: Column) -> Column:
    """The characters in order; a surrogate pair is one."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))
