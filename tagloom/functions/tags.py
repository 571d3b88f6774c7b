"""The thirteen tags and the Spark types they carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.errors import DocumentError

#: Names by number.
NAMES = ("End", "Byte", "Short", "Int", "Long", "Float", "Double", "ByteArray", "String", "List", "Compound", "IntArray", "LongArray")
END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTE_ARRAY, STRING, LIST, COMPOUND, INT_ARRAY, LONG_ARRAY = range(13)

#: Bytes of a payload that always has the same size.
WIDTHS = {BYTE: 1, SHORT: 2, INT: 4, LONG: 8, FLOAT: 4, DOUBLE: 8}
#: Bytes of an array's elements.
ELEMENTS = {BYTE_ARRAY: 1, INT_ARRAY: 4, LONG_ARRAY: 8}


def known(tag: int) -> int:
    if tag >= len(NAMES):
        raise DocumentError("UnknownTag", actual=tag)
    return tag


def tag_name(tag: Column) -> Column:
    """The name of a tag number; null if there is no such tag."""
    return F.get(F.array(*[F.lit(n) for n in NAMES]), tag.cast("int"))


def tag_number(name: Column) -> Column:
    """The number of a tag name; null if there is no such tag."""
    found = F.array_position(F.array(*[F.lit(n) for n in NAMES]), name)
    return F.when(found > 0, found - 1).cast("tinyint")


def root_tag(doc: Column) -> Column:
    """The root's tag number, without decoding anything."""
    return F.when(F.octet_length(doc) > 0, F.conv(F.hex(F.substring(doc, 1, 1)), 16, 10).cast("tinyint"))
