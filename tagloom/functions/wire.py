"""Big-endian numbers inside BINARY values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.functions.errors import ERROR, DocumentError
from tagloom.functions.types import parse_type

#: Layouts of the fixed-width elements.
LAYOUTS = {"tinyint": ">i1", "smallint": ">i2", "int": ">i4", "bigint": ">i8", "float": ">f4", "double": ">f8"}


def read_int(data: Column, start: int, width: int) -> Column:
    """The signed integer of `width` bytes at `start` (0-based); null beyond the end."""
    part = F.substring(data, start + 1, width)
    value = F.conv(F.hex(part), 16, -10).cast("bigint")
    if width < 8:
        value = F.when(value >= 1 << (8 * width - 1), value - (1 << (8 * width))).otherwise(value)
    return F.when(F.octet_length(part) == width, value)


def read_count(data: Column, start: int = 0) -> Column:
    """A length of four bytes; null if it is negative or cut off."""
    n = read_int(data, start, 4)
    return F.when(n >= 0, n)


def cast_from_bytes(data: Column, kind: str) -> Column:
    """STRUCT<value, error>: the elements that the bytes hold; a ragged end is an
    InvalidLength."""
    dtype = np.dtype(LAYOUTS[kind])
    out = parse_type(f"struct<value:array<{kind}>,error:{ERROR}>")
    arrow = to_arrow_type(out)

    def run(column: pa.Array) -> pa.Array:
        rows = []
        for x in column.to_pylist():
            value = error = None
            if x is not None and len(x) % dtype.itemsize:
                error = DocumentError("InvalidLength").row()
            elif x is not None:
                value = np.frombuffer(x, dtype).tolist()
            rows.append({"value": value, "error": error})
        return pa.array(rows, arrow)

    return F.arrow_udf(run, out).asNondeterministic()(data)


def cast_to_bytes(values: Column, kind: str) -> Column:
    """The elements' bytes, one after the other."""
    dtype = np.dtype(LAYOUTS[kind])

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.array(x, dtype).tobytes() for x in column.to_pylist()], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(values)
