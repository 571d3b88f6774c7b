"""Reading documents: one pass over the bytes by a plan, vectorised over a batch."""

from __future__ import annotations

import struct
from collections.abc import Callable
from decimal import Decimal
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
from tagloom.plans.schema import Entry, Node, compile_type, type_default

#: How deep a skipped payload may nest.
DEPTH = 512

Reader = Callable[[bytes, int], tuple[Any, int]]

_INT = struct.Struct(">i").unpack_from
_U16 = struct.Struct(">H").unpack_from
_NUMBERS = {(kind, tag): struct.Struct(f).unpack_from for kind, tag, f in (("int", G.BYTE, ">b"), ("int", G.SHORT, ">h"), ("int", G.INT, ">i"), ("int", G.LONG, ">q"), ("float", G.FLOAT, ">f"), ("float", G.DOUBLE, ">d"), ("u8", G.BYTE, ">B"))}
_DTYPES = {G.BYTE: ">i1", G.SHORT: ">i2", G.INT: ">i4", G.LONG: ">i8", G.FLOAT: ">f4", G.DOUBLE: ">f8"}


def _end() -> DocumentError:
    return DocumentError("UnexpectedEof")


def need(data: bytes, at: int, size: int) -> int:
    """Where the next `size` bytes end."""
    if at + size > len(data):
        raise _end()
    return at + size


def read_count(data: bytes, at: int) -> tuple[int, int]:
    need(data, at, 4)
    n = _INT(data, at)[0]
    if n < 0:
        raise DocumentError("InvalidLength")
    return n, at + 4


def read_tag(data: bytes, at: int) -> tuple[int, int]:
    need(data, at, 1)
    return G.known(data[at]), at + 1


def read_bytes(data: bytes, at: int) -> tuple[bytes, int]:
    """A string's or name's bytes as they are."""
    start = need(data, at, 2)
    end = need(data, start, _U16(data, at)[0])
    return data[start:end], end


def skip_payload(data: bytes, at: int, tag: int, depth: int = DEPTH) -> int:
    """Where the payload ends.  Names and strings inside are not validated."""
    if depth <= 0:
        raise DocumentError("InvalidData", detail="nested too deeply")
    if tag in G.WIDTHS:
        return need(data, at, G.WIDTHS[tag])
    if tag in G.ELEMENTS:
        n, at = read_count(data, at)
        return need(data, at, n * G.ELEMENTS[tag])
    if tag == G.STRING:
        start = need(data, at, 2)
        return need(data, start, _U16(data, at)[0])
    if tag == G.LIST:
        inner, at = read_tag(data, at)
        n, at = read_count(data, at)
        if inner == G.END:
            if n:
                raise DocumentError("InvalidData", detail="elements of a list of nothing")
            return at
        if inner in G.WIDTHS:
            return need(data, at, n * G.WIDTHS[inner])
        for _ in range(n):
            at = skip_payload(data, at, inner, depth - 1)
        return at
    if tag == G.COMPOUND:
        while True:
            inner, at = read_tag(data, at)
            if inner == G.END:
                return at
            start = need(data, at, 2)
            at = need(data, start, _U16(data, at)[0])
            at = skip_payload(data, at, inner, depth - 1)
    raise DocumentError("InvalidData", detail="an End tag has no payload")


def list_header(data: bytes, at: int, wanted: int) -> tuple[int, int]:
    """The number of elements; an empty list may announce any known tag."""
    tag, at = read_tag(data, at)
    n, at = read_count(data, at)
    if n == 0:
        return 0, at
    if tag == G.END:
        raise DocumentError("InvalidData", detail="elements of a list of nothing")
    if tag != wanted:
        raise DocumentError("InvalidTag", wanted, tag)
    return n, at


def _scalar(node: Node) -> Reader:
    unpack, width = _NUMBERS[node.kind, node.tag], node.width

    def read(data: bytes, at: int) -> tuple[Any, int]:
        end = need(data, at, width)
        return unpack(data, at)[0], end

    return read


def _fixed(node: Node) -> str | None:
    """The layout of an element that numpy can read."""
    if node.kind in ("int", "float"):
        return _DTYPES[node.tag]
    return ">u1" if node.kind == "u8" else None


def _sequence(node: Node, dialect: str) -> tuple[Reader, dict[int, Reader]]:
    """Readers of a list or array node: for its own tag, and for others it accepts."""
    item = node.item or Node("u8", G.BYTE, width=1)
    as_bytes = node.kind == "bytes"
    layout, one = _fixed(item), reader(item, dialect)

    def bulk(data: bytes, at: int, n: int, dtype: str, width: int) -> tuple[Any, int]:
        end = need(data, at, n * width)
        return (data[at:end] if as_bytes else np.frombuffer(data, dtype, n, at).tolist()), end

    def array(width: int) -> Reader:
        def read(data: bytes, at: int) -> tuple[Any, int]:
            n, at = read_count(data, at)
            return bulk(data, at, n, layout or ">u1", width)

        return read

    def listed(data: bytes, at: int) -> tuple[Any, int]:
        n, at = list_header(data, at, item.tag)
        if n > len(data) - at:  # counted in elements, whatever their size
            raise _end()
        if as_bytes or layout:
            return bulk(data, at, n, layout or ">u1", item.width)
        out = []
        for _ in range(n):
            value, at = one(data, at)
            out.append(value)
        return out, at

    own = listed if node.tag == G.LIST else array(node.width)
    if dialect == "native" or as_bytes:
        return own, {}
    # the other dialect takes any sequence whose elements fit
    others: dict[int, Reader] = {G.LIST: listed}
    for tag, inner in ((G.BYTE_ARRAY, G.BYTE), (G.INT_ARRAY, G.INT), (G.LONG_ARRAY, G.LONG)):
        if item.tag == inner and layout:
            others[tag] = array(G.ELEMENTS[tag])
        else:
            def misfit(data: bytes, at: int, inner: int = inner) -> tuple[Any, int]:
                n, at = read_count(data, at)
                if n:
                    raise DocumentError("InvalidTag", item.tag, inner)
                return [], at

            others[tag] = misfit
    return own, {t: r for t, r in others.items() if t != node.tag}


def accepted(node: Node, dialect: str) -> dict[int, Reader]:
    """Readers by the tags that the node takes; its own comes first."""
    if node.kind in ("list", "array", "bytes"):
        own, others = _sequence(node, dialect)
        return {node.tag: own} | others
    return {node.tag: reader(node, dialect)}


def reader(node: Node, dialect: str) -> Reader:
    kind = node.kind
    if kind in ("int", "float", "u8"):
        return _scalar(node)
    if kind in ("list", "array", "bytes"):
        return _sequence(node, dialect)[0]
    if kind == "compound":
        return _compound(node, dialect)
    if kind == "map":
        return _map(node, dialect)
    if kind == "raw":
        def raw(data: bytes, at: int) -> tuple[Any, int]:
            found, at = read_bytes(data, at)
            cesu8.decode(found)
            return found, at

        return raw
    if kind in ("string", "strict", "char"):
        def string(data: bytes, at: int) -> tuple[Any, int]:
            found, at = read_bytes(data, at)
            text = cesu8.decode(found)
            if kind == "strict" and len(found) != len(text.encode()):
                raise DocumentError("InvalidUtf8")
            if kind == "char" and len(text) != 1:
                raise DocumentError("InvalidData", detail="not exactly one character")
            return text, at

        return string
    if kind == "bool":
        def boolean(data: bytes, at: int) -> tuple[Any, int]:
            end = need(data, at, 1)
            return data[at] != 0, end

        return boolean
    signed = _scalar(Node("int", node.tag, width=node.width))  # u16, u32, u64

    def unsigned(data: bytes, at: int) -> tuple[Any, int]:
        value, at = signed(data, at)
        if value < 0:
            raise DocumentError("InvalidData", detail="negative number for an unsigned field")
        return (Decimal(value) if kind == "u64" else value), at

    return unsigned


def _map(node: Node, dialect: str) -> Reader:
    readers, wanted = accepted(node.item, dialect), node.item.tag

    def read(data: bytes, at: int) -> tuple[Any, int]:
        out = {}
        while True:
            tag, at = read_tag(data, at)
            if tag == G.END:
                return out, at
            name, at = read_bytes(data, at)
            key = cesu8.decode(name)
            if tag not in readers:
                raise DocumentError("InvalidTag", wanted, tag)
            out[key], at = readers[tag](data, at)

    return read


def _compound(node: Node, dialect: str) -> Reader:
    model = dialect == "model"
    by_name: dict[bytes, tuple[Entry, dict[int, Reader]]] = {}
    for e in node.fields:
        if e.read and not e.raw_self:
            readers = accepted(e.node, dialect)
            by_name.update({cesu8.encode(n): (e, readers) for n in e.names})
    longest = max(map(len, by_name), default=-1)
    strict_unit = model and not node.fields
    captures = [e.name for e in node.fields if e.raw_self]
    unread = {e.name: type_default(e.node) for e in node.fields if not e.read}

    def read(data: bytes, at: int) -> tuple[Any, int]:
        start, values = at, dict(unread)
        while True:
            tag, at = read_tag(data, at)
            if tag == G.END:
                break
            if strict_unit:
                raise DocumentError("InvalidData", detail="an entry in an empty compound")
            name, at = read_bytes(data, at)
            if model or (by_name and len(name) <= longest):
                cesu8.decode(name)  # names longer than any known one are passed over unread
            hit = by_name.get(name)
            if hit is None:
                at = skip_payload(data, at, tag)
                continue
            entry, readers = hit
            if entry.name in values:
                raise DocumentError("Message" if model else "DuplicateField", detail=f"duplicate field `{entry.read_key}`" if model else entry.read_key)
            if tag in readers:
                values[entry.name], at = readers[tag](data, at)
            elif entry.has_default and not model:
                at = skip_payload(data, at, tag)
                values[entry.name] = entry.default
            else:
                raise DocumentError("InvalidTag", entry.node.tag, tag)
        for e in node.fields:
            if e.name not in values and not e.raw_self:
                if e.has_default:
                    values[e.name] = e.default
                elif e.optional:
                    values[e.name] = None
                elif model:
                    raise DocumentError("Message", detail=f"missing field `{e.read_key}`")
                else:
                    raise DocumentError("MissingField", detail=e.read_key)
        for name in captures:
            values[name] = data[start:at]
        return values, at

    return read


def document_reader(kind: T.DataType, meta: dict | None = None, dialect: str = "native", framed: bool = True) -> Callable[[bytes], Any]:
    """A function from a document's bytes to a value; it raises DocumentError."""
    node = compile_type(kind, meta, dialect)
    readers = accepted(node, dialect)
    plain = reader(node, dialect)

    def read(data: bytes) -> Any:
        if not framed:
            return plain(data, 0)[0]
        tag, at = read_tag(data, 0)
        if tag not in readers:
            raise DocumentError("InvalidTag", node.tag, tag)
        at = read_bytes(data, at)[1]  # the root's name is not looked at
        return readers[tag](data, at)[0]

    return read


def decode(doc: Column, kind: T.DataType, meta: dict | None = None, dialect: str = "native", framed: bool = True) -> Column:
    """STRUCT<value, error>: the decoded value, or what is wrong with the document.

    Only the fields of `kind` are decoded; prune it to what a query needs.  The function
    counts as non-deterministic so that a filter on its result does not run it twice.
    A null document gives null for both."""
    compile_type(kind, meta, dialect)  # wrong schemas fail here, on the driver
    out = T.StructType([T.StructField("value", kind), T.StructField("error", parse_type(ERROR))])
    out = nullable(out)
    arrow = to_arrow_type(out)
    held: dict[str, Any] = {}

    def run(docs: pa.Array) -> pa.Array:
        if "read" not in held:
            held["read"] = document_reader(kind, meta, dialect, framed)
        read, values, errors = held["read"], [], []
        for data in docs.to_pylist():
            value = error = None
            if data is not None:
                try:
                    value = read(data)
                except DocumentError as e:
                    error = e.row()
            values.append(value)
            errors.append(error)
        fields = [arrow.field(0), arrow.field(1)]
        return pa.StructArray.from_arrays([pa.array(values, fields[0].type), pa.array(errors, fields[1].type)], fields=fields)

    return F.arrow_udf(run, out).asNondeterministic()(doc)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed throughout."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, nullable(kind.valueType), True)
    return kind


def decode_strict(doc: Column, kind: T.DataType, meta: dict | None = None, dialect: str = "native", framed: bool = True) -> Column:
    """The value; the first wrong document stops the query."""
    both = decode(doc, kind, meta, dialect, framed)
    wrong = F.concat(F.lit("document: "), both["error"]["code"], F.coalesce(F.concat(F.lit(" "), both["error"]["detail"]), F.lit("")))
    return F.when(both["error"].isNotNull(), F.raise_error(wrong).cast(nullable(kind).simpleString())).otherwise(both["value"])


def payload_length(doc: Column, tag: Column) -> Column:
    """Bytes of the payload that a BINARY starts with, -1 if it is malformed."""

    @F.arrow_udf("int")
    def measured(data: pa.Array, tags: pa.Array) -> pa.Array:
        def one(d: bytes | None, t: int | None) -> int | None:
            if d is None or t is None:
                return None
            try:
                return skip_payload(d, 0, G.known(t))
            except DocumentError:
                return -1

        return pa.array([one(d, t) for d, t in zip(data.to_pylist(), tags.to_pylist())], pa.int32())

    return measured(doc, tag.cast("int"))


def check_skip(doc: Column) -> Column:
    """The error of skipping a whole document, null if it is well formed."""

    @F.arrow_udf(ERROR)
    def checked(data: pa.Array) -> pa.Array:
        def one(d: bytes | None) -> dict | None:
            try:
                if d is not None:
                    tag, at = read_tag(d, 0)
                    skip_payload(d, read_bytes(d, at)[1], tag)
            except DocumentError as e:
                return e.row()
            return None

        return pa.array([one(d) for d in data.to_pylist()], to_arrow_type(parse_type(ERROR)))

    return checked(doc)
