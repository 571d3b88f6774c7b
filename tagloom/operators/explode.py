"""Documents without a schema: one row per value, with its path and tag."""

from __future__ import annotations

import struct
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.functions import cesu8
from tagloom.functions import tags as G
from tagloom.functions.errors import ERROR, DocumentError
from tagloom.functions.types import parse_type
from tagloom.operators.decode import DEPTH, list_header, need, read_bytes, read_count, read_tag

NODE = "struct<path:string,tag:tinyint,size:int,number:bigint,real:double,text:string,data:binary>"
_UNPACK = {tag: struct.Struct(dtype) for tag, dtype in {G.BYTE: ">b", G.SHORT: ">h", G.INT: ">i", G.LONG: ">q", G.FLOAT: ">f", G.DOUBLE: ">d"}.items()}
_INNER = {G.INT_ARRAY: G.INT, G.LONG_ARRAY: G.LONG}


def walk(data: bytes, at: int, tag: int, path: str, out: list[dict], depth: int = DEPTH) -> int:
    """Adds a row for the value and all inside it; returns where it ends."""
    if depth <= 0:
        raise DocumentError("InvalidData", detail="nested too deeply")
    row: dict[str, Any] = {"path": path, "tag": tag}
    out.append(row)
    if tag in _UNPACK:
        end = need(data, at, _UNPACK[tag].size)
        row["real" if tag in (G.FLOAT, G.DOUBLE) else "number"] = _UNPACK[tag].unpack_from(data, at)[0]
        return end
    if tag == G.STRING:
        found, at = read_bytes(data, at)
        row["text"] = cesu8.decode(found)
        return at
    if tag == G.BYTE_ARRAY:
        n, at = read_count(data, at)
        end = need(data, at, n)
        row["size"], row["data"] = n, data[at:end]
        return end
    if tag in _INNER:
        n, at = read_count(data, at)
        need(data, at, n * G.ELEMENTS[tag])
        row["size"] = n
        for i in range(n):
            at = walk(data, at, _INNER[tag], f"{path}[{i}]", out, depth - 1)
        return at
    if tag == G.LIST:
        inner = read_tag(data, at)[0]
        n, at = list_header(data, at, inner)
        if n > len(data) - at:
            raise DocumentError("UnexpectedEof")
        row["size"] = n
        for i in range(n):
            at = walk(data, at, inner, f"{path}[{i}]", out, depth - 1)
        return at
    if tag == G.COMPOUND:
        row["size"] = 0
        while True:
            inner, at = read_tag(data, at)
            if inner == G.END:
                return at
            name, at = read_bytes(data, at)
            row["size"] += 1
            at = walk(data, at, inner, f"{path}.{cesu8.decode(name)}", out, depth - 1)
    raise DocumentError("InvalidData", detail="an End tag has no value")


def document_nodes(data: bytes) -> list[dict]:
    tag, at = read_tag(data, 0)
    out: list[dict] = []
    walk(data, read_bytes(data, at)[1], tag, "$", out)
    return out


def nodes(doc: Column) -> Column:
    """STRUCT<nodes, error>: an array of NODE in document order, the root's path is $."""
    kind = parse_type(f"struct<nodes:array<{NODE}>,error:{ERROR}>")
    arrow = to_arrow_type(kind)

    def run(docs: pa.Array) -> pa.Array:
        rows = []
        for data in docs.to_pylist():
            found = error = None
            try:
                found = document_nodes(data) if data is not None else None
            except DocumentError as e:
                error = e.row()
            rows.append({"nodes": found, "error": error})
        return pa.array(rows, arrow)

    return F.arrow_udf(run, kind).asNondeterministic()(doc)


def explode_documents(df: DataFrame, doc: str, *keys: str) -> DataFrame:
    """keys and the columns of NODE, a row per value; malformed documents give none."""
    found = df.select(*keys, nodes(F.col(doc)).alias("__n"))
    return found.select(*keys, F.explode("__n.nodes").alias("__v")).select(*keys, "__v.*")
