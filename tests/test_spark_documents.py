"""Document columns in Spark: both encoders agree, errors are data, streams, files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import cesu8
from tagloom.functions import tags as G
from tagloom.functions.types import parse_type
from tagloom.operators.decode import check_skip, decode, decode_strict, payload_length
from tagloom.operators.encode import encode, encode_static
from tagloom.operators.explode import explode_documents
from tagloom.plans.schema import SchemaError
from tagloom.sources.files import read_document_files, slice_bytes, stream_document_files, write_documents
from tagloom.streaming.decode import decode_stream, run_available

KIND = T.StructType([
    T.StructField("i", T.IntegerType(), False),
    T.StructField("s", T.StringType(), False, {"key": "text\0🦀"}),
    T.StructField("l", T.ArrayType(T.LongType()), False),
    T.StructField("a", T.ArrayType(T.IntegerType()), False, {"array": "int"}),
    T.StructField("b", T.BooleanType(), False),
    T.StructField("n", T.StructType([T.StructField("x", T.ShortType(), False)]), False),
    T.StructField("d", T.BinaryType(), False, {"skip_if": "empty", "default": True}),
])
ROWS = [
    (1, "plain", [1, -2], [], True, (3,), b"\0\xff"),
    (-5, "a\0🦀é日", [], [2**31 - 1, -(2**31)], False, (-1,), b""),
    (0, "", [2**63 - 1], [0], True, (0,), b"x"),
]


@pytest.fixture(scope="module")
def rows(spark):
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in KIND.fields])
    return spark.createDataFrame(ROWS, kind).select(F.struct(*KIND.fieldNames()).alias("r"))


def test_both_encoders_agree(rows):
    got = rows.select(encode(F.col("r"), KIND)["doc"].alias("x"), encode_static(F.col("r"), KIND).alias("y"), decode(encode_static(F.col("r"), KIND), KIND).alias("d")).collect()
    for r, wanted in zip(got, ROWS):
        assert r["x"] == r["y"] and r["d"]["error"] is None
        v = r["d"]["value"]
        assert (v["i"], v["s"], v["l"], v["a"], v["b"], (v["n"]["x"],), bytes(v["d"])) == wanted


def test_decoder_runs_once(spark, rows):
    seen = decode(encode_static(F.col("r"), KIND), KIND)["value"]["i"]
    plan = rows.select(seen.alias("i")).where("i > 0")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1


def test_errors_are_data_or_stop(spark):
    docs = spark.createDataFrame([(bytearray.fromhex("0A00000300016100000001" + "00"),), (bytearray(b"\x0d"),), (None,)], "doc binary")
    kind = T.StructType([T.StructField("a", T.IntegerType(), False)])
    got = [r[0] for r in docs.select(decode(F.col("doc"), kind)).collect()]
    assert got[0]["value"]["a"] == 1 and got[1]["error"]["code"] == "UnknownTag" and got[1]["error"]["actual"] == 13
    assert got[2]["value"] is None and got[2]["error"] is None
    with pytest.raises(Exception, match="UnknownTag"):
        docs.select(decode_strict(F.col("doc"), kind)).collect()
    assert docs.where("doc is null or octet_length(doc) > 1").select(decode_strict(F.col("doc"), kind).alias("v")).where("v.a = 1").count() == 1


def test_schemas_fail_on_the_driver(spark):
    with pytest.raises(SchemaError):
        decode(F.col("doc"), T.StructType([T.StructField("d", T.DateType())]))
    with pytest.raises(ValueError):
        encode_static(F.col("r"), T.StructType([T.StructField("f", T.FloatType())]))


def test_cesu8_columns(spark):
    texts = ["", "a", "\0", "é日", "a\0🦀", "\U0010ffff\0￿"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select("t", cesu8.cesu8_encode(t).alias("b"), cesu8.cesu8_length(t).alias("n"), cesu8.needs_encoding(t).alias("odd"), cesu8.chars(t).alias("c"), cesu8.cesu8_decode(cesu8.cesu8_encode(t)).alias("back"), cesu8.try_decode(cesu8.cesu8_encode(t)).alias("tried"), cesu8.is_cesu8(F.encode(t, "UTF-8")).alias("ok")).collect()
    for r in got:
        text = r["t"]
        assert bytes(r["b"]) == cesu8.encode(text) and r["n"] == len(cesu8.encode(text)) and r["c"] == list(text) and r["back"] == text
        plain = cesu8.encode(text) == text.encode()
        assert r["odd"] is not plain and r["tried"] == (text if plain else None) and r["ok"] is plain


def test_probes_and_nodes(spark, rows):
    docs = rows.select(F.col("r.i").alias("i"), encode_static(F.col("r"), KIND).alias("doc"))
    doc = F.col("doc")
    got = docs.select(G.root_tag(doc).alias("t"), G.tag_name(G.root_tag(doc)).alias("n"), G.tag_number(F.lit("List")).alias("l"), payload_length(slice_bytes(doc, 3, 1 << 30), F.lit(10)).alias("p"), (F.octet_length(doc) - 3).alias("w"), check_skip(doc).alias("e")).collect()
    assert all((r["t"], r["n"], r["l"], r["p"], r["e"]) == (10, "Compound", 9, r["w"], None) for r in got)
    nodes = explode_documents(docs, "doc", "i").where("i = 1").select("path", "tag", "size").collect()
    assert [(r["path"], r["tag"]) for r in nodes[:4]] == [("$", 10), ("$.i", 3), ("$.text\0🦀", 8), ("$.l", 9)]
    assert nodes[0]["size"] == 7


def test_files_and_streams(spark, rows, tmp_path):
    docs = rows.select(encode_static(F.col("r"), KIND).alias("doc"))
    folder = tmp_path / "files"
    folder.mkdir()
    for i, r in enumerate(docs.collect()):
        (folder / f"{i}.bin").write_bytes(r["doc"])
    (folder / "bad.bin").write_bytes(b"\x0a")
    files = read_document_files(spark, str(folder), "*.bin")
    assert files.select(decode(F.col("doc"), KIND).alias("d")).where("d.error is null").count() == 3
    good, bad = decode_stream(stream_document_files(spark, str(folder), "*.bin"), "doc", KIND)
    got = run_available(good, f"{tmp_path}/good", f"{tmp_path}/good-state")
    assert sorted(r["i"] for r in got.collect()) == [-5, 0, 1]
    assert run_available(bad.select("code"), f"{tmp_path}/bad", f"{tmp_path}/bad-state").first()["code"] == "UnexpectedEof"
    write_documents(docs, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 3


def test_type_names():
    assert parse_type("struct<a:array<map<string,bigint>>,b:decimal(20,0)>").simpleString() == "struct<a:array<map<string,bigint>>,b:decimal(20,0)>"
    with pytest.raises(ValueError):
        parse_type("nothing")


def test_cesu8_columns_match_python(spark):
    """Spellings of random texts, and what the edges of the grammar decode to."""
    import itertools
    import random

    from test_cesu8 import ACCEPTED, EDGES, REFUSED

    rng = random.Random(3)
    texts = ["", "\0", "a\0", "\0a", "a\0\0🦀b", "🦀", "x" * 70_000 + "🦀" + "y" * 10] + ["".join(rng.choice("aé日\0🦀\U0010ffff") for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = rows.select("t", cesu8.cesu8_encode(rows.t).alias("b"), cesu8.cesu8_length(rows.t).alias("n")).collect()
    assert all(r.b is None if r.t is None else (bytes(r.b), r.n) == (cesu8.encode(r.t), len(cesu8.encode(r.t))) for r in got)

    data = [bytes.fromhex(x) for x in ACCEPTED + REFUSED] + [bytes(x) for n in (1, 2, 3) for x in itertools.product(EDGES, repeat=n)] + [cesu8.encode(t) for t in texts]
    spelled = spark.createDataFrame([(d,) for d in data] + [(None,)], "d binary")
    for r in spelled.select("d", cesu8.cesu8_decode(spelled.d).alias("t"), cesu8.is_cesu8(spelled.d).alias("ok")).collect():
        if r.d is None:
            assert r.t is None and r.ok is None
        elif cesu8.valid(bytes(r.d)):
            assert r.ok and r.t == cesu8.decode(bytes(r.d))
        else:
            assert r.t is None and r.ok is False, bytes(r.d).hex()
