"""From a Spark type and field metadata to a plan for reading and writing documents.

Metadata of a field (all optional):

  key, read_key, write_key   its name in documents: both ways, or one way
  aliases                    more names it is read under
  skip, skip_read, skip_write  left out both ways, or one way; unread fields get their
                             type's default, unwritten ones are still read
  skip_if                    "null", "empty" or "zero": not written when so
  default                    True for the type's default, or a value: used where the
                             key is absent or its tag differs
  array                      "byte", "int", "long" or "infer": an array, not a list;
                             "list" makes a list of bytes from BINARY
  mode                       STRING: "strict" (only text whose spelling is UTF-8),
                             "char"; BINARY: "raw" (a string's spelling); integers:
                             "u8", "u16", "u32", "u64"
  element                    metadata of an array's elements
  self                       BINARY: the enclosing compound's payload

Dialect "native" needs every key without a default; dialect "model" makes a nullable
field optional, reads arrays as lists, and lets maps stand for compounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from tagloom.functions import cesu8
from tagloom.functions import tags as G


class SchemaError(ValueError):
    """The schema has no document form."""


@dataclass
class Node:
    """How one value is laid out."""

    kind: str
    tag: int
    item: Node | None = None
    fields: list[Entry] = field(default_factory=list)
    width: int = 0


@dataclass
class Entry:
    """One field of a compound."""

    name: str
    node: Node
    read_key: str
    write_key: str
    aliases: tuple[str, ...] = ()
    read: bool = True
    write: bool = True
    skip_if: str | None = None
    has_default: bool = False
    default: Any = None
    optional: bool = False
    raw_self: bool = False

    @property
    def names(self) -> tuple[str, ...]:
        return (self.read_key, *self.aliases)


KNOWN = {"key", "read_key", "write_key", "aliases", "skip", "skip_read", "skip_write", "skip_if", "default", "array", "mode", "element", "self", "comment"}
_SCALARS = {T.ByteType: ("int", G.BYTE), T.ShortType: ("int", G.SHORT), T.IntegerType: ("int", G.INT), T.LongType: ("int", G.LONG), T.FloatType: ("float", G.FLOAT), T.DoubleType: ("float", G.DOUBLE), T.BooleanType: ("bool", G.BYTE)}
_UNSIGNED = {"u8": (T.ShortType, G.BYTE), "u16": (T.IntegerType, G.SHORT), "u32": (T.LongType, G.INT), "u64": (T.DecimalType, G.LONG)}
_ROUTES = {"byte": (G.BYTE_ARRAY, T.ByteType), "int": (G.INT_ARRAY, T.IntegerType), "long": (G.LONG_ARRAY, T.LongType)}


def compile_type(kind: T.DataType, meta: dict | None = None, dialect: str = "native") -> Node:
    """The plan of a type; SchemaError if there is none."""
    meta = meta or {}
    if odd := set(meta) - KNOWN:
        raise SchemaError(f"unknown metadata: {', '.join(sorted(odd))}")
    if dialect not in ("native", "model"):
        raise SchemaError(f"unknown dialect: {dialect}")
    mode, array = meta.get("mode"), meta.get("array")
    if isinstance(kind, T.StructType):
        return Node("compound", G.COMPOUND, fields=_fields(kind, dialect))
    if isinstance(kind, T.MapType):
        if dialect == "native":
            raise SchemaError("a map needs dialect 'model'")
        if not isinstance(kind.keyType, T.StringType):
            raise SchemaError("a map's keys must be strings")
        return Node("map", G.COMPOUND, item=compile_type(kind.valueType, meta.get("element"), dialect))
    if isinstance(kind, T.BinaryType):
        if mode == "raw":
            return Node("raw", G.STRING)
        if array in (None, "byte", "infer"):
            return Node("bytes", G.BYTE_ARRAY, width=1)
        if array == "list":
            return Node("bytes", G.LIST, width=1)
        raise SchemaError(f"BINARY has no array kind {array!r}")
    if isinstance(kind, T.ArrayType):
        element = meta.get("element") or {}
        if array is None:
            return Node("list", G.LIST, item=compile_type(kind.elementType, element, dialect))
        if array == "infer":
            found = [k for k, (_, t) in _ROUTES.items() if isinstance(kind.elementType, t)]
            if element.get("mode") == "u8" and isinstance(kind.elementType, T.ShortType):
                found = ["byte"]
            if not found:
                raise SchemaError(f"{kind.elementType.simpleString()} has no array kind")
            array = found[0]
        if array not in _ROUTES:
            raise SchemaError(f"unknown array kind: {array!r}")
        tag, wanted = _ROUTES[array]
        item = compile_type(kind.elementType, element, dialect)
        if not isinstance(kind.elementType, wanted) and not (array == "byte" and item.kind == "u8"):
            raise SchemaError(f"array kind {array!r} does not hold {kind.elementType.simpleString()}")
        return Node("array", tag, item=item, width=G.ELEMENTS[tag])
    if isinstance(kind, T.StringType):
        if mode not in (None, "strict", "char"):
            raise SchemaError(f"STRING has no mode {mode!r}")
        return Node({None: "string", "strict": "strict", "char": "char"}[mode], G.STRING)
    if mode in _UNSIGNED:
        wanted, tag = _UNSIGNED[mode]
        if not isinstance(kind, wanted) or isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) != (20, 0):
            raise SchemaError(f"mode {mode!r} does not fit {kind.simpleString()}")
        if mode != "u8" and dialect == "native":
            raise SchemaError(f"mode {mode!r} needs dialect 'model'")
        return Node(mode, tag, width=G.WIDTHS[tag])
    if mode is not None:
        raise SchemaError(f"{kind.simpleString()} has no mode {mode!r}")
    for known, (name, tag) in _SCALARS.items():
        if isinstance(kind, known):
            return Node(name, tag, width=G.WIDTHS[tag])
    raise SchemaError(f"{kind.simpleString()} has no document form")


def _key(text: str) -> str:
    if len(cesu8.encode(text)) > 0xFFFF:
        raise SchemaError("a key is longer than 65,535 bytes")
    return text


def _fields(kind: T.StructType, dialect: str) -> list[Entry]:
    out = []
    for f in kind.fields:
        meta = f.metadata or {}
        if odd := set(meta) - KNOWN:
            raise SchemaError(f"{f.name}: unknown metadata: {', '.join(sorted(odd))}")
        if "key" in meta and ("read_key" in meta or "write_key" in meta):
            raise SchemaError(f"{f.name}: key sets a direction that is set on its own")
        skip, unread, unwritten = (bool(meta.get(k)) for k in ("skip", "skip_read", "skip_write"))
        if skip and (unread or unwritten):
            raise SchemaError(f"{f.name}: skip and a direction of it")
        if "skip_if" in meta and (skip or unwritten):
            raise SchemaError(f"{f.name}: skip_if on a field that is never written")
        if meta.get("skip_if") not in (None, "null", "empty", "zero"):
            raise SchemaError(f"{f.name}: unknown skip_if")
        if "default" in meta and (skip or unread):
            raise SchemaError(f"{f.name}: default on a field that is never read")
        aliases = tuple(meta.get("aliases", ()))
        if aliases and (skip or unread or meta.get("self")):
            raise SchemaError(f"{f.name}: an alias on a field that is not read by name")
        read_key = _key(meta.get("read_key", meta.get("key", f.name)))
        if len(set(aliases)) < len(aliases) or read_key in aliases:
            raise SchemaError(f"{f.name}: a name is given twice")
        raw_self = bool(meta.get("self"))
        if raw_self and (not isinstance(f.dataType, T.BinaryType) or set(meta) - {"self", "comment"}):
            raise SchemaError(f"{f.name}: self needs a plain BINARY field")
        node = compile_type(f.dataType, {k: v for k, v in meta.items() if k in ("array", "mode", "element")}, dialect)
        default = meta.get("default")
        out.append(
            Entry(
                f.name, node, read_key, _key(meta.get("write_key", meta.get("key", f.name))), tuple(map(_key, aliases)),
                read=not (skip or unread), write=not (skip or unwritten or raw_self), skip_if=meta.get("skip_if"),
                has_default="default" in meta, default=type_default(node) if default is True and node.kind != "bool" else default,
                optional=dialect == "model" and f.nullable, raw_self=raw_self,
            )
        )
    for what, names in (
        ("field", [e.name for e in out]),
        ("write key", [e.write_key for e in out if e.write]),
        ("read key", [n for e in out if e.read and not e.raw_self for n in e.names]),
    ):
        if len(set(names)) < len(names):
            raise SchemaError(f"a {what} occurs twice: {sorted({n for n in names if names.count(n) > 1})}")
    return out


def type_default(node: Node) -> Any:
    """What a field gets that is never read."""
    kind = node.kind
    if kind in ("int", "u8", "u16", "u32"):
        return 0
    if kind == "u64":
        return Decimal(0)
    if kind == "compound":
        return {e.name: type_default(e.node) for e in node.fields}
    return {"float": 0.0, "bool": False, "string": "", "strict": "", "char": "\0", "raw": b"", "bytes": b"", "map": {}}.get(kind, [])


def with_meta(f: T.StructField, **meta) -> T.StructField:
    return T.StructField(f.name, f.dataType, f.nullable, (f.metadata or {}) | meta)


def prune(kind: T.StructType, names: list[str]) -> T.StructType:
    """The schema of some fields only: others are skipped, not decoded."""
    held = {f.name: f for f in kind.fields}
    if missing := [n for n in names if n not in held]:
        raise SchemaError(f"no such field: {missing[0]}")
    return T.StructType([held[n] for n in names])


__all__ = ["Entry", "Node", "SchemaError", "compile_type", "prune", "type_default", "with_meta"]
