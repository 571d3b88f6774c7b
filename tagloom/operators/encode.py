"""Writing documents, and the JVM-only form for layouts without floating point."""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.functions import cesu8
from tagloom.functions import tags as G
from tagloom.functions.errors import ERROR, DocumentError
from tagloom.functions.types import parse_type
from tagloom.operators.decode import _DTYPES
from tagloom.plans.schema import Entry, Node, compile_type

Writer = Callable[[Any], bytes]
_FORMATS = {("int", G.BYTE): ">b", ("int", G.SHORT): ">h", ("int", G.INT): ">i", ("int", G.LONG): ">q", ("float", G.FLOAT): ">f", ("float", G.DOUBLE): ">d", ("u8", G.BYTE): ">B"}


def write_count(n: int) -> bytes:
    if n > 0x7FFFFFFF:
        raise DocumentError("InvalidLength")
    return n.to_bytes(4, "big")


def write_string(data: bytes) -> bytes:
    if len(data) > 0xFFFF:
        raise DocumentError("InvalidLength")
    return len(data).to_bytes(2, "big") + data


def header(tag: int, name: bytes) -> bytes:
    return bytes([tag]) + write_string(name)


def _some(write: Writer) -> Writer:
    def checked(value: Any) -> bytes:
        if value is None:
            raise DocumentError("InvalidData", detail="null has no form")
        return write(value)

    return checked


def _sequence(node: Node, dialect: str) -> Writer:
    item, one = node.item, writer(node.item, dialect)
    dtype = _DTYPES.get(item.tag) if item.kind in ("int", "float") else ">u1" if item.kind == "u8" else None

    def write(values: list) -> bytes:
        if node.tag == G.LIST:
            head = bytes([item.tag if values else G.END]) + write_count(len(values))
        else:
            head = write_count(len(values))
        if dtype and None not in values:
            return head + (np.array(values, np.int64).astype(dtype) if item.kind != "float" else np.array(values, dtype)).tobytes()
        return head + b"".join(map(one, values))

    return write


def writer(node: Node, dialect: str) -> Writer:
    """Writes a payload; DocumentError if the value has none."""
    kind = node.kind
    if (kind, node.tag) in _FORMATS:
        return _some(lambda v, pack=struct.Struct(_FORMATS[kind, node.tag]).pack, mask=kind == "u8": pack(v & 255 if mask else v))
    if kind == "bool":
        return _some(lambda v: b"\1" if v else b"\0")
    if kind in ("string", "strict", "char"):
        def string(text: str) -> bytes:
            if kind == "char" and len(text) != 1:
                raise DocumentError("InvalidData", detail="not exactly one character")
            return write_string(cesu8.encode(text))

        return _some(string)
    if kind == "raw":
        def raw(data: bytes) -> bytes:
            cesu8.decode(data)
            return write_string(data)

        return _some(raw)
    if kind == "bytes":
        if node.tag == G.LIST:
            return _some(lambda v: bytes([G.BYTE if v else G.END]) + write_count(len(v)) + v)
        return _some(lambda v: write_count(len(v)) + v)
    if kind in ("list", "array"):
        return _some(_sequence(node, dialect))
    if kind == "compound":
        return _some(_compound(node, dialect))
    if kind == "map":
        tag, one = node.item.tag, writer(node.item, dialect)
        return _some(lambda v: b"".join(header(tag, cesu8.encode(k)) + one(x) for k, x in (v.items() if isinstance(v, dict) else v)) + b"\0")

    def unsigned(value: Any) -> bytes:
        value = int(value)
        if not 0 <= value < 1 << (8 * node.width - 1):
            raise DocumentError("InvalidData", detail="unsigned number out of range")
        return value.to_bytes(node.width, "big")

    return _some(unsigned)


def left_out(entry: Entry, value: Any) -> bool:
    if entry.skip_if == "null":
        return value is None
    if entry.skip_if == "empty":
        return value is None or len(value) == 0
    return entry.skip_if == "zero" and (value is None or value == 0)


def _compound(node: Node, dialect: str) -> Writer:
    parts = [(e, header(e.node.tag, cesu8.encode(e.write_key)), writer(e.node, dialect)) for e in node.fields if e.write]

    def write(value: dict) -> bytes:
        out = []
        for entry, head, one in parts:
            x = value[entry.name]
            if not left_out(entry, x):
                out.append(head)
                out.append(one(x))
        out.append(b"\0")
        return b"".join(out)

    return write


def document_writer(kind: T.DataType, meta: dict | None = None, dialect: str = "native", framed: bool = True) -> Writer:
    node = compile_type(kind, meta, dialect)
    one, head = writer(node, dialect), bytes([node.tag, 0, 0]) if framed else b""
    return lambda value: head + one(value)


def encode(value: Column, kind: T.DataType, meta: dict | None = None, dialect: str = "native", framed: bool = True) -> Column:
    """STRUCT<doc, error>: the document, or why the value has none."""
    compile_type(kind, meta, dialect)
    out = T.StructType([T.StructField("doc", T.BinaryType()), T.StructField("error", parse_type(ERROR))])
    arrow = to_arrow_type(out)
    held: dict[str, Writer] = {}

    def run(values: pa.Array) -> pa.Array:
        if "write" not in held:
            held["write"] = document_writer(kind, meta, dialect, framed)
        write, docs, errors = held["write"], [], []
        for x in values.to_pylist():
            doc = error = None
            try:
                doc = write(x)
            except DocumentError as e:
                error = e.row()
            docs.append(doc)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(docs, pa.binary()), pa.array(errors, arrow.field(1).type)], fields=[arrow.field(0), arrow.field(1)])

    return F.arrow_udf(run, out).asNondeterministic()(value)


# JVM only: numbers become hexadecimal text and then bytes


def big_endian(value: Column, width: int) -> Column:
    """An integer's last `width` bytes, BINARY."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.substring(digits, 17 - 2 * width, 2 * width))


def _static(node: Node, value: Column) -> Column:
    kind = node.kind
    if kind in ("int", "u8", "u16", "u32"):
        return big_endian(value, node.width)
    if kind == "bool":
        return F.unhex(F.when(value, "01").otherwise("00"))
    if kind in ("string", "strict"):
        data = cesu8.cesu8_encode(value)
        checked = F.when(F.octet_length(data) > 0xFFFF, F.raise_error(F.lit("document: InvalidLength")).cast("binary")).otherwise(data)
        return F.concat(big_endian(F.octet_length(data), 2), checked)
    if kind == "bytes" and node.tag == G.BYTE_ARRAY:
        return F.concat(big_endian(F.octet_length(value), 4), value)
    if kind in ("list", "array"):
        item = node.item
        body = F.unhex(F.array_join(F.transform(value, lambda x: F.hex(_static(item, x))), ""))
        n = big_endian(F.size(value), 4)
        if node.tag == G.LIST:
            return F.concat(F.unhex(F.when(F.size(value) > 0, f"{item.tag:02X}").otherwise("00")), n, body)
        return F.concat(n, body)
    if kind == "compound":
        parts = []
        for e in node.fields:
            if not e.write:
                continue
            x = value[e.name]
            entry = F.concat(F.unhex(F.lit(header(e.node.tag, cesu8.encode(e.write_key)).hex())), _static(e.node, x))
            if e.skip_if:
                omit = {"null": x.isNull(), "zero": x.isNull() | (x == 0)}.get(e.skip_if)
                if omit is None:
                    omit = x.isNull() | ((F.size(x) if e.node.kind in ("list", "array", "map") else F.octet_length(x)) == 0)
                entry = F.when(omit, F.lit(b"")).otherwise(entry)
            parts.append(entry)
        return F.concat(*parts, F.unhex(F.lit("00")))
    raise ValueError(f"{kind} has no JVM-only form")


def is_static(node: Node) -> bool:
    """Whether encode_static can write the layout."""
    if node.kind == "compound":
        return all(is_static(e.node) for e in node.fields if e.write)
    if node.kind in ("list", "array"):
        return is_static(node.item)
    return node.kind in ("int", "u8", "u16", "u32", "bool", "string", "strict") or node.kind == "bytes" and node.tag == G.BYTE_ARRAY


def encode_static(value: Column, kind: T.DataType, meta: dict | None = None, framed: bool = True) -> Column:
    """The document as a plain column expression; a null inside makes it null, and a
    string that is too long stops the query."""
    node = compile_type(kind, meta)
    if not is_static(node):
        raise ValueError("the layout holds floating point, maps or raw strings; use encode")
    body = _static(node, value)
    return F.concat(F.unhex(F.lit(f"{node.tag:02X}0000")), body) if framed else body


def rehydrate(payload: Column) -> Column:
    """A captured compound payload as a document again."""
    return F.concat(F.unhex(F.lit("0A0000")), payload)
