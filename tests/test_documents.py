"""Documents without Spark: golden bytes, malformed input, round trips."""

import random

import pytest
from pyspark.sql import types as T

from tagloom.functions import cesu8
from tagloom.functions.errors import DocumentError
from tagloom.functions.types import parse_type
from tagloom.operators.decode import document_reader, skip_payload
from tagloom.operators.encode import document_writer, header
from tagloom.operators.explode import document_nodes
from tagloom.plans.schema import SchemaError, compile_type, prune


def f(name, kind, nullable=False, **meta):
    return T.StructField(name, parse_type(kind) if isinstance(kind, str) else kind, nullable, meta)


def s(*fields):
    return T.StructType(list(fields))


def fails(read, data):
    with pytest.raises(DocumentError) as e:
        read(bytes.fromhex(data))
    return e.value


@pytest.mark.parametrize(
    "kind, meta, value, data",
    [
        (s(f("v", "array<int>", array="int")), {}, {"v": [1, -2]}, "0A0000 0B000176 00000002 00000001 FFFFFFFE 00"),
        (T.ArrayType(T.IntegerType()), {}, [1, -2], "090000 03 00000002 00000001 FFFFFFFE"),
        (T.ArrayType(T.IntegerType()), {}, [], "090000 00 00000000"),
        (s(), {}, {}, "0A0000 00"),
        (s(f("kept", "string")), {}, {"kept": "abc"}, "0A0000 080004 6B657074 0003 616263 00"),
        (T.ArrayType(T.ShortType()), {"element": {"mode": "u8"}}, [0, 1, 255], "090000 01 00000003 0001FF"),
        (T.ArrayType(T.ShortType()), {}, [-2, 258], "090000 02 00000002 FFFE 0102"),
        (T.ArrayType(T.FloatType()), {}, [1.5], "090000 05 00000001 3FC00000"),
        (T.ArrayType(T.DoubleType()), {}, [-2.25], "090000 06 00000001 C002000000000000"),
        (T.StringType(), {}, "a\0🦀", "080000 0009 61 C080 EDA0BE EDB680"),
        (s(f("x", "binary", array="list")), {}, {"x": b"\1\2"}, "0A0000 090001 78 01 00000002 0102 00"),
    ],
)
def test_golden(kind, meta, value, data):
    data = bytes.fromhex(data)
    assert document_writer(kind, meta)(value) == data
    assert document_reader(kind, meta)(data) == value
    assert document_reader(kind, meta)(data + b"rest") == value


def test_unicode_key():
    assert header(1, cesu8.encode("名前\0😀"))[3:].hex().upper() == "E5908DE5898DC080EDA0BDEDB880"
    kind = s(f("mixed", "tinyint", key="名前\0😀"))
    assert document_reader(kind)(document_writer(kind)({"mixed": 7})) == {"mixed": 7}


@pytest.mark.parametrize(
    "kind, data, code, expected, actual, detail",
    [
        (T.IntegerType(), "", "UnexpectedEof", None, None, None),
        (T.IntegerType(), "0D", "UnknownTag", None, 13, None),
        (T.LongType(), "030000 00000001", "InvalidTag", 4, 3, None),
        (s(f("a", "string")), "0A0000 03000161 00000001 00", "InvalidTag", 8, 3, None),
        (s(f("v", "array<int>", array="int")), "0A0000 0B000176 FFFFFFFF", "InvalidLength", None, None, None),
        (s(f("v", "binary")), "0A0000 07000176 7FFFFFFF", "UnexpectedEof", None, None, None),
        (T.ArrayType(T.IntegerType()), "090000 00 00000005", "InvalidData", None, None, "elements of a list of nothing"),
        (T.ArrayType(T.IntegerType()), "090000 04 00000001 0000000000000001", "InvalidTag", 3, 4, None),
        (T.ArrayType(T.ShortType()), "090000 02 00000002 0001", "UnexpectedEof", None, None, None),
        (s(f("a", "int")), "0A0000 03000161 0000", "UnexpectedEof", None, None, None),
        (s(f("b", "int", read_key="z")), "0A0000 00", "MissingField", None, None, "z"),
        (s(f("x", "int", key="😀")), "0A0000 030004 F09F9880 00000001 00", "InvalidUtf8", None, None, None),
        (s(f("value", "int", aliases=["VALUE"])), "0A0000 030005 76616C7565 00000001 080005 56414C5545 0000 00", "DuplicateField", None, None, "value"),
    ],
)
def test_malformed(kind, data, code, expected, actual, detail):
    error = fails(document_reader(kind), data)
    assert (error.code, error.expected, error.actual, error.detail) == (code, expected, actual, detail)


@pytest.mark.parametrize("tag", [0, 1, 4, 10])
def test_empty_list_of_any_tag(tag):
    assert document_reader(T.ArrayType(T.IntegerType()))(bytes.fromhex(f"090000 {tag:02X} 00000000")) == []


def test_first_missing_field_in_order():
    read = document_reader(s(f("a", "int"), f("b", "int")))
    assert fails(read, "0A0000 00").detail == "a"


def test_defaults():
    kind = s(f("shorts", "array<smallint>", default=True), f("after", "int", default=True))
    read = document_reader(kind)
    assert read(bytes.fromhex("0A0000 030006 73686F727473 00000001 030005 6166746572 0000002A 00")) == {"shorts": [], "after": 42}
    error = fails(read, "0A0000 090006 73686F727473 03 00000001 00000001 00")
    assert (error.code, error.expected, error.actual) == ("InvalidTag", 2, 3)
    with_value = document_reader(s(f("n", "int", default=42), f("l", "array<int>", default=[2])))
    assert with_value(bytes.fromhex("0A0000 00")) == {"n": 42, "l": [2]}
    wrong_alias = document_reader(s(f("value", "int", aliases=["VALUE"], default=True)))
    assert wrong_alias(bytes.fromhex("0A0000 080005 56414C5545 0000 00")) == {"value": 0}


def test_raw_capture_keeps_what_is_skipped():
    read = document_reader(s(f("value", "int", default=True), f("raw", "binary", self=True)))
    body = "080003 616263 0000 030005 76616C7565 00000007 00"
    assert read(bytes.fromhex("0A0002 6161" + body)) == {"value": 7, "raw": bytes.fromhex(body)}


def test_names_longer_than_known_ones_are_not_validated():
    read = document_reader(s(f("ab", "int", default=True)))
    assert read(bytes.fromhex("0A0000 010003 FFFFFF 01 00")) == {"ab": 0}
    assert fails(read, "0A0000 010002 FFFF 01 00").code == "InvalidUtf8"


def test_skipping():
    nested = lambda n: bytes.fromhex("0900000001" * n + "0000000000")
    assert skip_payload(nested(511), 0, 9) == 5 * 512
    with pytest.raises(DocumentError) as e:
        skip_payload(nested(512), 0, 9)
    assert e.value.code == "InvalidData"
    assert skip_payload(bytes.fromhex("0002FFFF"), 0, 8) == 4  # strings are passed over unread
    with pytest.raises(DocumentError):
        skip_payload(bytes.fromhex("0D00000000"), 0, 9)


def test_strict_and_raw_strings():
    kind = s(f("a", "string", mode="strict"))
    data = document_writer(s(f("a", "string")))({"a": "x\0"})
    assert fails(document_reader(kind), data.hex()).code == "InvalidUtf8"
    assert document_reader(s(f("a", "binary", mode="raw")))(data) == {"a": b"x\xc0\x80"}


def test_lengths_on_write():
    write = document_writer(T.StringType())
    assert len(write("a" * 65_535)) == 65_540
    for text in ("a" * 65_536, "\0" * 32_768):
        with pytest.raises(DocumentError) as e:
            write(text)
        assert e.value.code == "InvalidLength"


def test_model_dialect():
    kind = s(f("value", "int"), f("maybe", "int", True, skip_if="null"))
    write, read = document_writer(kind, dialect="model"), document_reader(kind, dialect="model")
    assert read(write({"value": 1, "maybe": None})) == {"value": 1, "maybe": None}
    plain = s(f("value", "int", True))
    with pytest.raises(DocumentError) as e:
        document_writer(plain, dialect="model")({"value": None})
    assert e.value.code == "InvalidData"
    assert fails(document_reader(s(f("x", "int")), dialect="model"), "0A0000 00").code == "Message"
    map_ = T.MapType(T.StringType(), T.IntegerType())
    assert document_reader(map_, dialect="model")(document_writer(map_, dialect="model")({"b": 1, "a": 2})) == {"b": 1, "a": 2}
    lists = T.ArrayType(T.IntegerType())
    array = document_writer(lists, {"array": "int"})([3, 4])
    assert document_reader(lists, dialect="model")(array) == [3, 4]
    assert fails(document_reader(lists), array.hex()).code == "InvalidTag"
    entry = "0A0000 010001 61 01 00"
    assert document_reader(s())(bytes.fromhex(entry)) == {}
    assert fails(document_reader(s(), dialect="model"), entry).code == "InvalidData"
    unsigned = T.LongType()
    assert fails(document_reader(unsigned, {"mode": "u32"}, "model"), "030000 FFFFFFFF").code == "InvalidData"
    with pytest.raises(DocumentError):
        document_writer(unsigned, {"mode": "u32"}, "model")(1 << 31)
    assert fails(document_reader(T.StringType(), {"mode": "char"}, "model"), "080000 0002 7879").code == "InvalidData"


@pytest.mark.parametrize(
    "fields",
    [
        [f("a", "date")],
        [f("a", "decimal(10,2)")],
        [f("a", "map<string,int>")],
        [f("a", "int", key="k"), f("b", "int", key="k")],
        [f("a", "int"), f("b", "int", aliases=["a"])],
        [f("a", "int", aliases=["a"])],
        [f("a", "int", aliases=["b", "b"])],
        [f("a", "int", aliases=["b"], skip_read=True)],
        [f("a", "int", key="x", read_key="y")],
        [f("a", "int", skip=True, skip_write=True)],
        [f("a", "int", skip_if="null", skip=True)],
        [f("a", "int", skip_if="odd")],
        [f("a", "int", default=1, skip_read=True)],
        [f("a", "int", self=True)],
        [f("a", "binary", self=True, default=True)],
        [f("a", "array<int>", array="short")],
        [f("a", "array<smallint>", array="infer")],
        [f("a", "array<bigint>", array="int")],
        [f("a", "int", colour="red")],
        [f("a", "int", key="k" * 65_536)],
    ],
)
def test_rejected_schemas(fields):
    with pytest.raises(SchemaError):
        compile_type(s(*fields))


def test_swapped_keys_are_allowed():
    kind = s(f("a", "int", write_key="b", read_key="a"), f("b", "int", write_key="a", read_key="b"))
    assert document_reader(kind)(document_writer(kind)({"a": 1, "b": 2})) == {"a": 2, "b": 1}
    assert prune(kind, ["b"]).fieldNames() == ["b"]


def test_nodes():
    kind = s(f("a", "array<int>"), f("b", s(f("c", "string"))), f("d", "double"))
    rows = document_nodes(document_writer(kind)({"a": [5, 6], "b": {"c": "x"}, "d": 0.5}))
    assert [(r["path"], r["tag"]) for r in rows] == [("$", 10), ("$.a", 9), ("$.a[0]", 3), ("$.a[1]", 3), ("$.b", 10), ("$.b.c", 8), ("$.d", 6)]


def test_floats_keep_their_bits():
    kind = T.ArrayType(T.DoubleType())
    for bits in ("8000000000000000", "7FF0000000000000", "FFF0000000000000", "7FF8000000000001", "0000000000000001"):
        data = bytes.fromhex(f"090000 06 00000001 {bits}")
        assert document_writer(kind)(document_reader(kind)(data)) == data


def test_random_documents_never_crash():
    seed = 20_261
    rng = random.Random(seed)
    kind = s(f("a", "int"), f("b", "array<string>"), f("c", s(f("x", "array<bigint>", array="long"), f("y", "double"))), f("t", "string"))
    write, read = document_writer(kind), document_reader(kind)
    for i in range(3_000):
        value = {
            "a": rng.randrange(-(2**31), 2**31),
            "b": ["".join(rng.choice("ab\0é日🦀") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(4))],
            "c": {"x": [rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(4))], "y": rng.random()},
            "t": "".join(rng.choice("ab\0é日🦀") for _ in range(rng.randrange(6))),
        }
        data = write(value)
        assert read(data) == value, (seed, i)
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        for attempt in (bytes(broken), bytes(broken[: rng.randrange(len(broken))])):
            for reads in (read, document_nodes):
                try:
                    reads(attempt)
                except DocumentError:
                    pass
