"""Spark types from their short names, without a session."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {
    "tinyint": T.ByteType, "byte": T.ByteType, "smallint": T.ShortType, "short": T.ShortType, "int": T.IntegerType, "bigint": T.LongType, "long": T.LongType,
    "float": T.FloatType, "double": T.DoubleType, "boolean": T.BooleanType, "string": T.StringType, "binary": T.BinaryType, "date": T.DateType, "timestamp": T.TimestampType,
}


def _split(text: str) -> list[str]:
    """The parts between commas that stand in no brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]] if text.strip() else []


def parse_type(text: str) -> T.DataType:
    text = text.strip()
    head, _, rest = text.partition("<")
    inner = rest[:-1]
    if head == "array":
        return T.ArrayType(parse_type(inner))
    if head == "map":
        key, value = _split(inner)
        return T.MapType(parse_type(key), parse_type(value))
    if head == "struct":
        fields = [p.strip().partition(":") for p in _split(inner)]
        return T.StructType([T.StructField(name, parse_type(kind)) for name, _, kind in fields])
    if text.startswith("decimal("):
        precision, scale = _split(text[8:-1])
        return T.DecimalType(int(precision), int(scale))
    if text not in _SIMPLE:
        raise ValueError(f"no such type: {text}")
    return _SIMPLE[text]()
