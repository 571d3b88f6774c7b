"""Registered queries over the driver's tables, each with the same result in SQL.

Documents are built from table rows, by one encoder where possible and read by the
other decoder, so that a fault of one side shows.  Bytes are compared as hexadecimal
text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import cesu8
from tagloom.functions import tags as G
from tagloom.functions import wire
from tagloom.functions.types import parse_type
from tagloom.operators.decode import check_skip, decode, nullable, payload_length
from tagloom.operators.encode import big_endian, encode, encode_static, rehydrate
from tagloom.operators.explode import explode_documents
from tagloom.plans.schema import prune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str, kind: T.DataType | str, nullable: bool = False, **meta) -> T.StructField:
    kind = parse_type(kind) if isinstance(kind, str) else kind
    return T.StructField(name, kind, nullable, meta)


def record(*fields: T.StructField) -> T.StructType:
    return T.StructType(list(fields))


def row(kind: T.StructType, *values: Column | str) -> Column:
    """A struct of the schema's fields."""
    given = [F.col(v) if isinstance(v, str) else v for v in values] or [F.col(f.name) for f in kind.fields]
    return F.struct(*[v.cast(nullable(f.dataType)).alias(f.name) for v, f in zip(given, kind.fields)])


def written(kind: T.DataType, value: Column, **options) -> Column:
    return encode(value, kind, **options)["doc"]


def code(doc: Column, kind: T.DataType, **options) -> Column:
    return F.coalesce(decode(doc, kind, **options)["error"]["code"], F.lit("ok"))


# SQL for the bytes of a document, as hexadecimal text


def sql_int(expression: str, width: int) -> str:
    return f"right(lpad(hex(({expression})::BIGINT), 16, '0'), {2 * width})"


def sql_string(expression: str) -> str:
    return f"{sql_int(f'strlen({expression})', 2)} || hex({expression})"


def sql_key(tag: int, key: str) -> str:
    data = key.encode()
    return f"'{tag:02X}{len(data):04X}{data.hex().upper()}'"


ROOT = "'0A0000'"

NATION = record(field("n_nationkey", "int"), field("n_name", "string"), field("n_regionkey", "int"))
SQL_NATION = f"{ROOT} || {sql_key(3, 'n_nationkey')} || {sql_int('n_nationkey', 4)} || {sql_key(8, 'n_name')} || {sql_string('n_name')} || {sql_key(3, 'n_regionkey')} || {sql_int('n_regionkey', 4)} || '00'"
REGION = record(field("r_regionkey", "int"), field("r_name", "string"))
CUSTOMER = record(field("c_custkey", "bigint"), field("c_name", "string"), field("c_nationkey", "int"), field("c_acctbal", "double"), field("c_mktsegment", "string"))
SUPPLIER = record(field("s_suppkey", "bigint"), field("s_name", "string"), field("s_nationkey", "int"), field("s_acctbal", "double"))
PART = record(field("p_partkey", "bigint"), field("p_name", "string"), field("p_brand", "string"), field("p_type", "string"), field("p_size", "int"), field("p_retailprice", "double"))
ORDERS = record(field("o_orderkey", "bigint"), field("o_custkey", "bigint"), field("o_orderstatus", "string"), field("o_totalprice", "double"), field("o_orderdate_us", "bigint"), field("o_orderpriority", "string"))
ITEM = record(field("l_linenumber", "int"), field("l_partkey", "bigint"), field("l_quantity", "double"))
ORDER = record(field("o_orderkey", "bigint"), field("o_orderstatus", "string"), field("o_totalprice", "double"), field("items", T.ArrayType(ITEM)))


def micros(column: str) -> Column:
    """A timestamp as a Long of microseconds: this engine's choice, the format has none."""
    return F.unix_micros(F.col(column).cast("timestamp"))


@query(f"SELECT n_nationkey, {SQL_NATION} AS doc FROM nation")
def doc_encode_nation(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.hex(encode_static(row(NATION), NATION)).alias("doc"))


@query(f"SELECT n_nationkey, {SQL_NATION} AS doc FROM nation")
def doc_encode_vectorised(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.hex(written(NATION, row(NATION))).alias("doc"))


def _roundtrip(name: str, kind: T.StructType, static: bool, sql: str) -> None:
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, name)
        if name == "orders":
            rows = rows.withColumn("o_orderdate_us", micros("o_orderdate"))
        doc = encode_static(row(kind), kind) if static else written(kind, row(kind))
        return rows.select(decode(doc, kind)["value"].alias("v")).select("v.*")

    query(sql, f"doc_roundtrip_{name}")(run)


_roundtrip("region", REGION, True, "SELECT r_regionkey, r_name FROM region")
_roundtrip("customer", CUSTOMER, False, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
_roundtrip("supplier", SUPPLIER, False, "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
_roundtrip("part", PART, False, "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
_roundtrip("orders", ORDERS, False, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate_us, o_orderpriority FROM orders")


@query("SELECT o_orderkey, 10::INT AS tag, 'Compound' AS tag_name, 40 + strlen(o_orderstatus) AS n_bytes FROM orders")
def doc_header_probe(spark, sf_dir):
    kind = record(field("o_orderkey", "bigint"), field("status", "string"))
    doc = encode_static(row(kind, "o_orderkey", "o_orderstatus"), kind)
    return table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc")).select(
        "o_orderkey", G.root_tag(F.col("doc")).cast("int").alias("tag"), G.tag_name(G.root_tag(F.col("doc"))).alias("tag_name"),
        (F.octet_length("doc") + 4).cast("bigint").alias("n_bytes"),
    )


def _scalar(name: str, source: str, keys: list[str], kind: str, expression: str, tag: int, width: int, sql_type: str, **meta) -> None:
    schema = record(field("v", kind, **meta))

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, source).select(*keys, F.expr(expression).cast(kind).alias("v"))
        docs = rows.select(*keys, written(schema, F.struct("v")).alias("doc"))
        return docs.select(*keys, F.hex("doc").alias("doc"), decode(F.col("doc"), schema)["value"]["v"].alias("v"))

    query(f"SELECT {', '.join(keys)}, {ROOT} || {sql_key(tag, 'v')} || {sql_int(expression, width)} || '00' AS doc, ({expression})::{sql_type} AS v FROM {source}", name)(run)


LINE = ["l_orderkey", "l_linenumber"]
_scalar("scalar_byte", "lineitem", LINE, "tinyint", "l_linenumber * 20 - 100", 1, 1, "TINYINT")
_scalar("scalar_short", "part", ["p_partkey"], "smallint", "p_size * 600 - 15000", 2, 2, "SMALLINT")
_scalar("scalar_int", "part", ["p_partkey"], "int", "p_size * 40000000 - 1000000000", 3, 4, "INTEGER")
_scalar("scalar_long", "lineitem", LINE, "bigint", "(l_partkey - 100) * 1000000007", 4, 8, "BIGINT")


@query("SELECT l_orderkey, l_linenumber, ((l_orderkey % 256))::SMALLINT AS v, right(lpad(hex(l_orderkey % 256), 16, '0'), 2) AS byte FROM lineitem")
def scalar_u8_wrap(spark, sf_dir):
    kind = record(field("v", "smallint", mode="u8"))
    docs = table(spark, sf_dir, "lineitem").select(*LINE, written(kind, F.struct((F.col("l_orderkey") % 256).cast("smallint").alias("v"))).alias("doc"))
    return docs.select(*LINE, decode(F.col("doc"), kind)["value"]["v"].alias("v"), F.hex(F.substring("doc", 8, 1)).alias("byte"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AS v FROM lineitem")
def scalar_bool(spark, sf_dir):
    as_byte, as_bool = record(field("v", "tinyint")), record(field("v", "boolean"))
    doc = encode_static(F.struct((F.col("l_linenumber") % 3 * -7).cast("tinyint").alias("v")), as_byte)
    return table(spark, sf_dir, "lineitem").select(*LINE, decode(doc, as_bool)["value"]["v"].alias("v"))


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice::FLOAT)::DOUBLE AS v FROM lineitem")
def scalar_float(spark, sf_dir):
    kind = record(field("v", "float"))
    doc = written(kind, F.struct(F.col("l_extendedprice").cast("float").alias("v")))
    return table(spark, sf_dir, "lineitem").select(*LINE, decode(doc, kind)["value"]["v"].cast("double").alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem")
def scalar_double(spark, sf_dir):
    kind = record(field("v", "double"))
    doc = written(kind, F.struct(F.col("l_extendedprice").alias("v")))
    return table(spark, sf_dir, "lineitem").select(*LINE, decode(doc, kind)["value"]["v"].alias("v"))


# strings: documents have neither NUL nor characters beyond U+FFFF, so some get them
ODD = "\0🦀"
SQL_ODD = "CASE WHEN doc_id % 3 = 0 THEN text || chr(0) || chr(129408) ELSE text END"
BODY = record(field("body", "string"))
SQL_DOCS = f"(SELECT doc_id, {SQL_ODD} AS t, doc_id % 3 = 0 AS odd, text AS plain, strlen(text) + CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 0 END > 65535 AS too_long FROM documents)"


def _texts(spark, sf_dir) -> DataFrame:
    """The whole texts, and doc: a document of one string each, null where the spelling
    has more than the 65,535 bytes that a string holds."""
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(ODD))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", odd.alias("t"))
    doc = F.when(cesu8.cesu8_length(F.col("t")) <= 65_535, encode_static(F.struct(F.col("t").alias("body")), BODY))
    return rows.withColumn("doc", doc)


@query(f"SELECT doc_id, CASE WHEN NOT too_long THEN length(t) END AS n, CASE WHEN NOT too_long THEN sha256(t) END AS digest FROM {SQL_DOCS}")
def string_roundtrip(spark, sf_dir):
    got = decode(F.col("doc"), BODY)["value"]["body"]
    return _texts(spark, sf_dir).select("doc_id", got.alias("b")).select("doc_id", F.length("b").cast("bigint").alias("n"), F.sha2("b", 256).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN NOT too_long THEN hex(plain) || CASE WHEN odd THEN 'C080EDA0BEEDB680' ELSE '' END END AS raw FROM {SQL_DOCS}")
def string_raw(spark, sf_dir):
    kind = record(field("body", "binary", mode="raw"))
    return _texts(spark, sf_dir).select("doc_id", F.hex(decode(F.col("doc"), kind)["value"]["body"]).alias("raw"))


@query(f"SELECT doc_id, CASE WHEN too_long THEN 'InvalidLength' WHEN odd THEN 'InvalidUtf8' ELSE 'ok' END AS outcome FROM {SQL_DOCS}")
def string_strict(spark, sf_dir):
    kind = record(field("body", "string", mode="strict"))
    return _texts(spark, sf_dir).select("doc_id", F.when(F.col("doc").isNull(), "InvalidLength").otherwise(code(F.col("doc"), kind)).alias("outcome"))


@query(f"SELECT doc_id, strlen(plain) + CASE WHEN odd THEN 8 ELSE 0 END AS n, strlen(plain) + CASE WHEN odd THEN 8 ELSE 0 END AS counted FROM {SQL_DOCS}")
def cesu8_encode_length(spark, sf_dir):
    t = F.col("t")
    return _texts(spark, sf_dir).select("doc_id", F.octet_length(cesu8.cesu8_encode(t)).cast("bigint").alias("n"), cesu8.cesu8_length(t).cast("bigint").alias("counted"))


@query(f"SELECT doc_id, odd AS needs, NOT odd AS borrowed FROM {SQL_DOCS}")
def cesu8_needs_encoding(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", cesu8.needs_encoding(F.col("t")).alias("needs"), cesu8.try_from_str(F.col("t")).isNotNull().alias("borrowed"))


@query(f"SELECT doc_id, NOT odd AS as_utf8, true AS as_spelling, doc_id % 2 = 0 AS cut FROM {SQL_DOCS}")
def cesu8_validate(spark, sf_dir):
    spelled = cesu8.cesu8_encode(F.col("t"))
    cut = F.when(F.col("doc_id") % 2 == 0, spelled).otherwise(F.concat(spelled, F.unhex(F.lit("EDA081"))))
    return _texts(spark, sf_dir).select("doc_id", cesu8.is_cesu8(F.encode("t", "UTF-8")).alias("as_utf8"), cesu8.is_cesu8(spelled).alias("as_spelling"), cesu8.is_cesu8(cut).alias("cut"))


@query(f"SELECT doc_id, sha256(t) AS digest, CASE WHEN odd THEN NULL ELSE sha256(t) END AS tried FROM {SQL_DOCS}")
def cesu8_decode(spark, sf_dir):
    spelled = cesu8.cesu8_encode(F.col("t"))
    return _texts(spark, sf_dir).select("doc_id", F.sha2(cesu8.cesu8_decode(spelled), 256).alias("digest"), F.sha2(cesu8.try_decode(spelled), 256).alias("tried"))


@query(f"SELECT doc_id, length(plain) + CASE WHEN odd THEN 2 ELSE 0 END AS n FROM {SQL_DOCS}")
def cesu8_chars(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.size(cesu8.chars(F.col("t"))).cast("bigint").alias("n"))


@query("SELECT doc_id, hex(text) || 'C08061' AS pushed FROM documents")
def cesu8_push(spark, sf_dir):
    spelled = cesu8.cesu8_encode(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(cesu8.push_str(spelled, F.lit("\0a"))).alias("pushed"))


SAMPLES = ["7F", "00", "EFBFBF", "F0908080", "EE8080", "C3A9", "41", "F09FA680"]
SPELLED = ["7F", "C080", "EFBFBF", "EDA080EDB080", "EE8080", "C3A9", "41", "EDA0BEEDB680"]


@query(
    "SELECT n_nationkey, spelled, rank() OVER (ORDER BY spelled) AS place FROM (SELECT n_nationkey, CASE n_nationkey % 8 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SPELLED)) + " END AS spelled FROM nation)"
)
def cesu8_sort_order(spark, sf_dir):
    texts = F.element_at(F.array(*[F.lit(bytes.fromhex(s).decode()) for s in SAMPLES]), F.col("n_nationkey") % 8 + 1)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", cesu8.cesu8_encode(texts).alias("b"))
    smaller = rows.groupBy("b").count().alias("x").join(rows.select("b").distinct().alias("y"), F.col("x.b") < F.col("y.b"))  # eight spellings
    ranks = smaller.groupBy(F.col("y.b").alias("b")).agg(F.sum("count").alias("less"))
    return rows.join(ranks, "b", "left").select("n_nationkey", F.hex("b").alias("spelled"), (F.coalesce("less", F.lit(0)) + 1).cast("bigint").alias("place"))


@query("SELECT doc_id, CASE WHEN strlen(repeat(text, 20)) > 65535 THEN 'InvalidLength' ELSE 'ok' END AS outcome FROM documents")
def string_too_long(spark, sf_dir):
    value = F.struct(F.expr("repeat(text, 20)").alias("body"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(encode(value, BODY)["error"]["code"], F.lit("ok")).alias("outcome"))


# lists and arrays


def _lines(spark, sf_dir, *values: Column) -> DataFrame:
    """Per order, arrays in the order of line numbers (an order has a few lines)."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", *values))).alias("s"))
    return rows


def _listed(name: str, kind: T.StructType, value: str, head: str, item: str, total: str = "sum(v)") -> None:
    """Per order: the document's bytes, and size and sum of what is decoded."""

    def run(spark, sf_dir):
        rows = _lines(spark, sf_dir, F.expr(value).alias("v")).select("l_orderkey", F.struct(F.col("s.v").alias("v")).alias("r"))
        docs = rows.select("l_orderkey", written(kind, F.col("r")).alias("doc"))
        got = decode(F.col("doc"), kind)["value"]["v"]
        return docs.select("l_orderkey", F.hex("doc").alias("doc"), got.alias("g")).select(
            "l_orderkey", "doc", F.size("g").cast("bigint").alias("n"), F.aggregate("g", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")
        )

    sql = f"SELECT l_orderkey, {ROOT} || {head} || {sql_int('count(*)', 4)} || string_agg({item}, '' ORDER BY l_linenumber, v) || '00' AS doc, count(*) AS n, {total}::BIGINT AS total FROM (SELECT l_orderkey, l_linenumber, {VALUES[name]} AS v FROM lineitem) GROUP BY l_orderkey"
    query(sql, name)(run)


VALUES = {
    "list_int": "l_partkey * 3 - 500", "array_int": "l_partkey * 3 - 500", "array_long": "(l_partkey - 50) * 10000000019",
    "array_infer": "l_suppkey - 40", "list_short": "l_linenumber * 100 - 300", "array_byte": "l_linenumber * 30 - 120", "list_long": "l_suppkey * 5000000029",
}
_listed("list_int", record(field("v", "array<int>")), "cast(l_partkey * 3 - 500 as int)", f"{sql_key(9, 'v')} || '03'", sql_int("v", 4))
_listed("list_short", record(field("v", "array<smallint>")), "cast(l_linenumber * 100 - 300 as smallint)", f"{sql_key(9, 'v')} || '02'", sql_int("v", 2))
_listed("list_long", record(field("v", "array<bigint>")), "l_suppkey * 5000000029", f"{sql_key(9, 'v')} || '04'", sql_int("v", 8))
_listed("array_int", record(field("v", "array<int>", array="int")), "cast(l_partkey * 3 - 500 as int)", sql_key(11, "v"), sql_int("v", 4))
_listed("array_long", record(field("v", "array<bigint>", array="long")), "(l_partkey - 50) * 10000000019", sql_key(12, "v"), sql_int("v", 8))
_listed("array_infer", record(field("v", "array<bigint>", array="infer")), "l_suppkey - 40", sql_key(12, "v"), sql_int("v", 8))
_listed("array_byte", record(field("v", "array<tinyint>", array="byte")), "cast(l_linenumber * 30 - 120 as tinyint)", sql_key(7, "v"), sql_int("v", 1))


@query("SELECT p_partkey, upper(sha256(p_name)) AS digest, strlen(p_name) AS n FROM part")
def array_bytes_binary(spark, sf_dir):
    kind = record(field("v", "binary", array="byte"))
    doc = encode_static(F.struct(F.encode("p_name", "UTF-8").alias("v")), kind)
    got = table(spark, sf_dir, "part").select("p_partkey", decode(doc, kind)["value"]["v"].alias("b"))
    return got.select("p_partkey", F.upper(F.sha2("b", 256)).alias("digest"), F.octet_length("b").cast("bigint").alias("n"))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS flags FROM lineitem GROUP BY l_orderkey")
def list_string(spark, sf_dir):
    kind = record(field("v", "array<string>"))
    rows = _lines(spark, sf_dir, F.concat("l_returnflag", "l_linestatus").alias("v"))
    doc = encode_static(F.struct(F.col("s.v").alias("v")), kind)
    return rows.select("l_orderkey", F.array_join(decode(doc, kind)["value"]["v"], ",").alias("flags"))


@query("SELECT vec_id, len(embedding) AS n, (embedding[1])::DOUBLE AS first, (embedding[64])::DOUBLE AS last, 0::BIGINT AS changed FROM embeddings")
def list_float(spark, sf_dir):
    kind = record(field("v", "array<float>"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", decode(written(kind, F.struct(F.col("embedding").alias("v"))), kind)["value"]["v"].alias("g"))
    changed = F.size(F.filter(F.zip_with("embedding", "g", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    return rows.select("vec_id", F.size("g").cast("bigint").alias("n"), F.get("g", F.lit(0)).cast("double").alias("first"), F.get("g", F.lit(63)).cast("double").alias("last"), changed.cast("bigint").alias("changed"))


@query("SELECT l_orderkey, count(*) AS n, sum(l_linenumber + l_partkey)::BIGINT AS total FROM lineitem GROUP BY l_orderkey")
def list_nested(spark, sf_dir):
    kind = record(field("v", "array<array<int>>"))
    rows = _lines(spark, sf_dir, F.array("l_linenumber", F.col("l_partkey").cast("int")).alias("v"))
    got = rows.select("l_orderkey", decode(written(kind, F.struct(F.col("s.v").alias("v"))), kind)["value"]["v"].alias("g"))
    return got.select("l_orderkey", F.size("g").cast("bigint").alias("n"), F.aggregate(F.flatten("g"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"SELECT p_partkey, {ROOT} || {sql_key(9, 'v')} || CASE WHEN p_size % 2 = 0 THEN '0000000000' ELSE '0300000001' || {sql_int('p_size', 4)} END || '00' AS doc, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS n FROM part")
def list_empty(spark, sf_dir):
    kind = record(field("v", "array<int>"))
    doc = encode_static(F.struct(F.expr("if(p_size % 2 = 0, cast(array() as array<int>), array(p_size))").alias("v")), kind)
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(doc).alias("doc"), F.size(decode(doc, kind)["value"]["v"]).cast("bigint").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 13 = 0 OR p_size % 13 <= 12 THEN 'ok' END AS outcome, 0::BIGINT AS n FROM part")
def list_empty_any_tag(spark, sf_dir):
    """An empty list may announce any known tag."""
    kind = record(field("v", "array<int>"))
    doc = F.concat(F.unhex(F.lit("0A000009000176")), big_endian(F.col("p_size") % 13, 1), F.unhex(F.lit("0000000000")))
    got = table(spark, sf_dir, "part").select("p_partkey", decode(doc, kind).alias("d"))
    return got.select("p_partkey", F.coalesce("d.error.code", F.lit("ok")).alias("outcome"), F.size("d.value.v").cast("bigint").alias("n"))


# compounds


@query("SELECT conv_id, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn, sum(strlen(text))::BIGINT AS n_bytes, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id")
def compound_list(spark, sf_dir):
    turn = record(field("turn", "bigint"), field("role", "string"), field("text", "string"))
    kind = record(field("turns", T.ArrayType(turn)))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    got = rows.select("conv_id", decode(written(kind, F.struct("turns")), kind)["value"]["turns"].alias("t"))
    return got.select(
        "conv_id", F.size("t").cast("bigint").alias("n"), F.array_min("t.turn").alias("first_turn"), F.array_max("t.turn").alias("last_turn"),
        F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["text"])).alias("n_bytes"), F.array_join("t.role", ",").alias("roles"),
    )


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and doc, an order with its lines inside.  Lines are grouped by their
    order before the join, so both sides meet on one shuffle of the key."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", written(ORDER, row(ORDER)).alias("doc"))


@query("SELECT o_orderkey, o_orderstatus, count(*) AS n_items, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus")
def orders_with_items(spark, sf_dir):
    """The flagship: nested documents, read back with only the fields in use.  Counting
    and summing decoded values is Spark's own."""
    wanted = record(*prune(ORDER, ["o_orderkey", "o_orderstatus"]).fields, field("items", T.ArrayType(prune(ITEM, ["l_quantity"]))))
    got = order_documents(spark, sf_dir).select(decode(F.col("doc"), wanted)["value"].alias("v")).select("v.*")
    return got.select("o_orderkey", "o_orderstatus", F.size("items").cast("bigint").alias("n_items"), F.aggregate("items.l_quantity", F.lit(0.0), lambda a, x: a + x).alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def project_subset(spark, sf_dir):
    kind = record(field("l_orderkey", "bigint"), field("l_linenumber", "int"), field("l_quantity", "double"), field("l_extendedprice", "double"), field("l_discount", "double"), field("l_returnflag", "string"), field("l_linestatus", "string"))
    doc = written(kind, row(kind))
    wanted = prune(kind, ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"])
    return table(spark, sf_dir, "lineitem").select(decode(doc, wanted)["value"].alias("v")).select("v.*")


@query("SELECT o_orderkey, o_orderstatus FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey")
def unknown_fields_skipped(spark, sf_dir):
    """Lists of compounds, strings and numbers that the reader does not know."""
    got = order_documents(spark, sf_dir).select(decode(F.col("doc"), prune(ORDER, ["o_orderkey", "o_orderstatus"]))["value"].alias("v"))
    return got.select("v.*")


def _customers(kind: T.StructType, read: T.StructType, values: list[str], columns: dict[str, Callable[[Column], Column]], sql: str, name: str, **options) -> None:
    """c_custkey, the document written by one schema, and what the other reads."""

    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "customer").select("c_custkey", written(kind, row(kind, *map(F.expr, values))).alias("doc"))
        got = docs.select("c_custkey", "doc", decode(F.col("doc"), read, **options).alias("d"))
        return got.select("c_custkey", F.hex("doc").alias("doc"), *[f(F.col("d")).alias(n) for n, f in columns.items()])

    query(sql, name)(run)


OK = {"outcome": lambda d: F.coalesce(d["error"]["code"], F.lit("ok"))}
_name = sql_string("c_name")
_customers(
    record(field("name", "string", write_key="n")), record(field("who", "string", read_key="n")), ["c_name"], {"who": lambda d: d["value"]["who"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(8, 'n')} || {_name} || '00' AS doc, c_name AS who FROM customer", "field_rename",
)
_customers(
    record(field("a", "string", key="Status")), record(field("status", "string", aliases=["Status"])), ["c_mktsegment"], {"status": lambda d: d["value"]["status"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(8, 'Status')} || {sql_string('c_mktsegment')} || '00' AS doc, c_mktsegment AS status FROM customer", "field_alias",
)
_customers(
    record(field("cache", "bigint", skip=True), field("name", "string")), record(field("cache", "bigint", skip=True), field("name", "string")), ["c_custkey", "c_name"],
    {"cache": lambda d: d["value"]["cache"], "name": lambda d: d["value"]["name"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(8, 'name')} || {_name} || '00' AS doc, 0::BIGINT AS cache, c_name AS name FROM customer", "field_skip",
)
_customers(
    record(field("gone", "bigint", skip_write=True), field("name", "string")), record(field("gone", "bigint", skip_write=True), field("name", "string")), ["c_custkey", "c_name"],
    OK | {"detail": lambda d: d["error"]["detail"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(8, 'name')} || {_name} || '00' AS doc, 'MissingField' AS outcome, 'gone' AS detail FROM customer", "field_skip_write",
)
_customers(
    record(field("hidden", "bigint", skip_read=True), field("name", "string")), record(field("hidden", "bigint", skip_read=True), field("name", "string")), ["c_custkey", "c_name"],
    {"hidden": lambda d: d["value"]["hidden"], "name": lambda d: d["value"]["name"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(4, 'hidden')} || {sql_int('c_custkey', 8)} || {sql_key(8, 'name')} || {_name} || '00' AS doc, 0::BIGINT AS hidden, c_name AS name FROM customer", "field_skip_read",
)
_customers(
    record(field("name", "string")), record(field("name", "string"), field("level", "int", default=42), field("tags", "array<int>", default=True), field("note", "string", default=True)), ["c_name"],
    {"level": lambda d: d["value"]["level"], "tags": lambda d: F.size(d["value"]["tags"]), "note": lambda d: d["value"]["note"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(8, 'name')} || {_name} || '00' AS doc, 42::INT AS level, 0::INT AS tags, '' AS note FROM customer", "field_default",
)
_customers(
    record(field("level", "string"), field("after", "int")), record(field("level", "int", default=7), field("after", "int")), ["c_name", "c_nationkey"],
    {"level": lambda d: d["value"]["level"], "after": lambda d: d["value"]["after"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(8, 'level')} || {_name} || {sql_key(3, 'after')} || {sql_int('c_nationkey', 4)} || '00' AS doc, 7::INT AS level, c_nationkey AS after FROM customer", "field_default_wrong_tag",
)
_customers(
    record(field("shorts", "array<int>"), field("after", "int")), record(field("shorts", "array<smallint>", default=True), field("after", "int")), ["array(c_nationkey)", "c_nationkey"],
    OK | {"actual": lambda d: d["error"]["actual"].cast("int")},
    f"SELECT c_custkey, {ROOT} || {sql_key(9, 'shorts')} || '0300000001' || {sql_int('c_nationkey', 4)} || {sql_key(3, 'after')} || {sql_int('c_nationkey', 4)} || '00' AS doc, 'InvalidTag' AS outcome, 3::INT AS actual FROM customer", "field_default_inner_error",
)
_customers(
    record(field("maybe", "string", skip_if="empty"), field("kept", "int")), record(field("maybe", "string", default=True), field("kept", "int")),
    ["if(c_custkey % 2 = 0, '', c_name)", "c_nationkey"], {"maybe": lambda d: d["value"]["maybe"], "kept": lambda d: d["value"]["kept"]},
    f"SELECT c_custkey, {ROOT} || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE {sql_key(8, 'maybe')} || {_name} END || {sql_key(3, 'kept')} || {sql_int('c_nationkey', 4)} || '00' AS doc, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS maybe, c_nationkey AS kept FROM customer", "field_skip_if",
)
POINT = record(field("x", "int"), field("y", "int"))
_customers(
    record(field("start", POINT), field("end", POINT)), record(field("end", POINT), field("start", POINT)),
    ["struct(c_nationkey AS x, -c_nationkey AS y)", "struct(1 AS x, c_nationkey AS y)"],
    {"sx": lambda d: d["value"]["start"]["x"], "sy": lambda d: d["value"]["start"]["y"], "ey": lambda d: d["value"]["end"]["y"]},
    f"SELECT c_custkey, {ROOT} || {sql_key(10, 'start')} || {sql_key(3, 'x')} || {sql_int('c_nationkey', 4)} || {sql_key(3, 'y')} || {sql_int('-c_nationkey', 4)} || '00' || {sql_key(10, 'end')} || {sql_key(3, 'x')} || '00000001' || {sql_key(3, 'y')} || {sql_int('c_nationkey', 4)} || '0000' AS doc, c_nationkey AS sx, -c_nationkey AS sy, c_nationkey AS ey FROM customer", "nested_compound",
)


# malformed documents


def _broken(name: str, kind: T.StructType, good: str, bad: str, outcome: str, **options) -> None:
    """Rows with an odd key get the malformed document."""

    def run(spark, sf_dir):
        doc = F.unhex(F.when(F.col("c_custkey") % 2 == 1, F.lit(bad)).otherwise(F.lit(good)))
        return table(spark, sf_dir, "customer").select("c_custkey", code(doc, kind, **options).alias("outcome"))

    query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN '{outcome}' ELSE 'ok' END AS outcome FROM customer", name)(run)


A_INT, A_STR = record(field("a", "int")), record(field("a", "string"))
STATUS = record(field("status", "int", aliases=["Status"]))
V_LIST, V_INTS = record(field("v", "array<int>")), record(field("v", "array<int>", array="int"))
GOOD_A, GOOD_S = "0A000003000161" + "0000002A" + "00", "0A0000080001610002686900"
_st, _st2 = "030006737461747573" + "00000001", "030006537461747573" + "00000002"
_broken("error_duplicate_field", STATUS, f"0A0000{_st}00", f"0A0000{_st}{_st2}00", "DuplicateField")
_broken("error_duplicate_before_tag", STATUS, f"0A0000{_st2}00", f"0A0000{_st}080006537461747573000161" + "00", "DuplicateField")
_broken("error_missing_field", A_INT, GOOD_A, "0A000000", "MissingField")
_broken("error_wrong_tag", A_INT, GOOD_A, GOOD_S, "InvalidTag")
_broken("error_root_tag", A_INT, GOOD_A, "03000000000001", "InvalidTag")
_broken("error_truncated", A_INT, GOOD_A, "0A0000030001610000", "UnexpectedEof")
_broken("error_empty", A_INT, GOOD_A, "", "UnexpectedEof")
_broken("error_negative_length", V_INTS, "0A00000B000176" + "0000000000", "0A00000B000176" + "FFFFFFFF00", "InvalidLength")
_broken("error_count_too_large", V_INTS, "0A00000B000176" + "0000000000", "0A00000B000176" + "7FFFFFFF00", "UnexpectedEof")
_broken("error_unknown_tag", A_INT, GOOD_A, "0D", "UnknownTag")
_broken("error_bad_utf8", A_STR, GOOD_S, "0A00000800016100" + "04F09F988000", "InvalidUtf8")
_broken("error_bad_key", record(field("a", "int"), field("bbbb", "int", default=True)), GOOD_A, "0A0000030004F09F9880" + "00000001" + GOOD_A[6:], "InvalidUtf8")
_broken("error_end_list", V_LIST, "0A0000090001760000000000" + "00", "0A0000090001760000000005" + "00", "InvalidData")
_broken("error_list_tag", V_LIST, "0A0000090001760300000001" + "0000000100", "0A0000090001760400000001" + "000000000000000100", "InvalidTag")
_broken("error_negative_unsigned", record(field("a", "bigint", mode="u32")), GOOD_A, "0A000003000161" + "FFFFFFFF" + "00", "InvalidData", dialect="model")
_broken("lenient_trailing_and_name", A_INT, GOOD_A, "0A0003FFFFFF" + GOOD_A[6:] + "ABCD", "ok")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 >= 2 THEN 'InvalidData' ELSE 'ok' END AS outcome FROM customer")
def error_too_deep(spark, sf_dir):
    """Unread lists nested 510, 511, 512 and 513 deep below a field."""
    depth = F.lit(510) + F.col("c_custkey") % 4
    lists = F.concat(F.repeat(F.lit("0900000001"), depth.cast("int")), F.lit("0000000000"))
    doc = F.unhex(F.concat(F.lit("0A0000090001780900000001"[:14]), lists, F.lit("00")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(decode(doc, record())["error"]["code"], F.lit("ok")).alias("outcome"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'UnexpectedEof' ELSE 'UnknownTag' END AS outcome FROM customer")
def check_documents(spark, sf_dir):
    """Well-formedness without a schema."""
    kind = record(field("c_name", "string"))
    doc = encode_static(row(kind), kind)
    doc = F.when(F.col("c_custkey") % 3 == 0, doc).when(F.col("c_custkey") % 3 == 1, F.expr("substring(d, 1, octet_length(d) - 1)")).otherwise(F.expr("concat(substring(d, 1, octet_length(d) - 1), unhex('4D'))"))
    rows = table(spark, sf_dir, "customer").withColumn("d", encode_static(row(kind), kind))
    return rows.select("c_custkey", F.coalesce(check_skip(doc)["code"], F.lit("ok")).alias("outcome"))


# raw payloads, roots that are no compounds


@query(f"SELECT c_custkey, substring({ROOT} || {sql_key(8, 'c_name')} || {_name} || {sql_key(3, 'c_nationkey')} || {sql_int('c_nationkey', 4)} || '00', 7) AS raw FROM customer")
def raw_capture(spark, sf_dir):
    """The whole payload, keys that the reader skips included."""
    kind = record(field("c_name", "string"), field("c_nationkey", "int"))
    read = record(field("c_nationkey", "int"), field("raw", "binary", self=True))
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(decode(encode_static(row(kind), kind), read)["value"]["raw"]).alias("raw"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def raw_rehydrate(spark, sf_dir):
    kind = record(field("c_name", "string"), field("c_nationkey", "int"))
    raw = decode(encode_static(row(kind), kind), record(field("raw", "binary", self=True)))["value"]["raw"]
    rows = table(spark, sf_dir, "customer").select("c_custkey", decode(rehydrate(raw), kind)["value"].alias("v"))
    return rows.select("c_custkey", "v.*")


@query(f"SELECT r_regionkey, '080000' || {sql_string('r_name')} AS doc, r_name AS name FROM region")
def newtype_doc(spark, sf_dir):
    kind = T.StringType()
    doc = encode_static(F.col("r_name"), kind)
    return table(spark, sf_dir, "region").select("r_regionkey", F.hex(doc).alias("doc"), decode(doc, kind)["value"].alias("name"))


@query(f"SELECT r_regionkey, '090000' || '0300000002' || {sql_int('r_regionkey', 4)} || {sql_int('-r_regionkey', 4)} AS doc, '0300000002' || {sql_int('r_regionkey', 4)} || {sql_int('-r_regionkey', 4)} AS payload FROM region")
def root_list(spark, sf_dir):
    kind = T.ArrayType(T.IntegerType())
    value = F.array("r_regionkey", -F.col("r_regionkey"))
    return table(spark, sf_dir, "region").select("r_regionkey", F.hex(encode_static(value, kind)).alias("doc"), F.hex(encode_static(value, kind, framed=False)).alias("payload"))


@query("SELECT r_regionkey, 'ok' AS native, CASE WHEN r_regionkey % 2 = 0 THEN 'ok' ELSE 'InvalidData' END AS model FROM region")
def unit_doc(spark, sf_dir):
    """A compound without fields: one dialect skips entries, the other refuses them."""
    doc = F.unhex(F.when(F.col("r_regionkey") % 2 == 0, "0A000000").otherwise(GOOD_A))
    return table(spark, sf_dir, "region").select("r_regionkey", code(doc, record()).alias("native"), code(doc, record(), dialect="model").alias("model"))


# the other dialect


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN NULL ELSE user_id END AS maybe FROM events")
def model_option(spark, sf_dir):
    kind = record(field("event_id", "bigint"), field("maybe", "bigint", nullable=True, skip_if="null"))
    value = row(kind, "event_id", F.when(F.col("user_id") % 2 == 1, F.col("user_id")))
    got = table(spark, sf_dir, "events").select(decode(written(kind, value, dialect="model"), kind, dialect="model")["value"].alias("v"))
    return got.select("v.*")


@query(f"SELECT p_partkey, {ROOT} || {sql_key(3, 'size')} || {sql_int('p_size', 4)} || {sql_key(3, 'twice')} || {sql_int('p_size * 2', 4)} || '00' AS doc, p_size AS size, p_size * 2 AS twice FROM part")
def model_map(spark, sf_dir):
    kind = T.MapType(T.StringType(), T.IntegerType())
    value = F.create_map(F.lit("size"), F.col("p_size"), F.lit("twice"), F.col("p_size") * 2)
    docs = table(spark, sf_dir, "part").select("p_partkey", written(kind, value, dialect="model").alias("doc"))
    got = docs.select("p_partkey", "doc", decode(F.col("doc"), kind, dialect="model")["value"].alias("m"))
    return got.select("p_partkey", F.hex("doc").alias("doc"), F.col("m")["size"].alias("size"), F.col("m")["twice"].alias("twice"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'InvalidData' END AS outcome FROM part")
def model_char(spark, sf_dir):
    kind = record(field("body", "string", mode="char"))
    value = F.when(F.col("p_size") % 2 == 0, F.substring("p_name", 1, 1)).otherwise(F.substring("p_name", 1, 2))
    return table(spark, sf_dir, "part").select("p_partkey", code(encode_static(F.struct(value.alias("body")), BODY), kind, dialect="model").alias("outcome"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'InvalidData' ELSE 'ok' END AS outcome, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 1000 END::BIGINT AS v FROM part")
def model_unsigned(spark, sf_dir):
    kind = record(field("v", "bigint", mode="u32"))
    value = F.when(F.col("p_size") % 3 == 0, F.lit(3_000_000_000)).otherwise(F.col("p_size") * 1000)
    rows = table(spark, sf_dir, "part").select("p_partkey", encode(F.struct(value.cast("bigint").alias("v")), kind, dialect="model").alias("e"))
    return rows.select("p_partkey", F.coalesce("e.error.code", F.lit("ok")).alias("outcome"), decode(F.col("e.doc"), kind, dialect="model")["value"]["v"].alias("v"))


@query("SELECT l_orderkey, 'InvalidTag' AS native, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_orderkey")
def model_seq_from_array(spark, sf_dir):
    arrays, lists = record(field("v", "array<int>", array="int")), record(field("v", "array<int>"))
    rows = _lines(spark, sf_dir).select("l_orderkey", written(arrays, F.struct(F.col("s.l_linenumber").alias("v"))).alias("doc"))
    got = rows.select("l_orderkey", code(F.col("doc"), lists).alias("native"), decode(F.col("doc"), lists, dialect="model")["value"]["v"].alias("g"))
    return got.select("l_orderkey", "native", F.size("g").cast("bigint").alias("n"), F.aggregate("g", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


# numbers inside bytes


@query("SELECT l_orderkey, l_linenumber, l_partkey - 100 AS long, (l_linenumber - 4)::BIGINT AS int, CASE WHEN l_linenumber >= 4 THEN (l_linenumber - 4)::BIGINT END AS count FROM lineitem")
def wire_read_int(spark, sf_dir):
    data = F.concat(big_endian(F.col("l_partkey") - 100, 8), big_endian(F.col("l_linenumber") - 4, 4))
    rows = table(spark, sf_dir, "lineitem").select(*LINE, data.alias("b"))
    return rows.select(*LINE, wire.read_int(F.col("b"), 0, 8).alias("long"), wire.read_int(F.col("b"), 8, 4).alias("int"), wire.read_count(F.col("b"), 8).alias("count"))


@query(f"SELECT p_partkey, {sql_int('p_size', 4)} || {sql_int('-p_size', 4)} AS bytes, CASE WHEN p_size % 2 = 0 THEN p_size END AS first, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'InvalidLength' END AS outcome FROM part")
def wire_cast(spark, sf_dir):
    """Odd sizes get a ragged end."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", wire.cast_to_bytes(F.array("p_size", -F.col("p_size")), "int").alias("b"))
    ragged = F.when(F.col("p_size") % 2 == 0, F.col("b")).otherwise(F.concat("b", F.lit(b"x")))
    got = rows.select("p_partkey", F.hex("b").alias("bytes"), wire.cast_from_bytes(ragged, "int").alias("c"))
    return got.select("p_partkey", "bytes", F.get("c.value", F.lit(0)).alias("first"), F.coalesce("c.error.code", F.lit("ok")).alias("outcome"))


# documents without a schema, streams


@query(
    "SELECT n_nationkey, '$' AS path, 'Compound' AS tag, NULL::BIGINT AS number, NULL AS text FROM nation UNION ALL "
    "SELECT n_nationkey, '$.n_nationkey', 'Int', n_nationkey, NULL FROM nation UNION ALL "
    "SELECT n_nationkey, '$.n_name', 'String', NULL, n_name FROM nation UNION ALL "
    "SELECT n_nationkey, '$.n_regionkey', 'Int', n_regionkey, NULL FROM nation"
)
def dynamic_explode(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select("n_nationkey", encode_static(row(NATION), NATION).alias("doc"))
    return explode_documents(docs, "doc", "n_nationkey").select("n_nationkey", "path", G.tag_name(F.col("tag")).alias("tag"), "number", "text")


@query(f"SELECT n_nationkey, length({SQL_NATION}) // 2 - 3 AS n FROM nation")
def payload_lengths(spark, sf_dir):
    doc = encode_static(row(NATION), NATION)
    payload = F.concat(F.substring(doc, 4, 1 << 30), F.lit(b"more"))
    return table(spark, sf_dir, "nation").select("n_nationkey", payload_length(payload, F.lit(10)).cast("bigint").alias("n"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def events_stream_decode(spark, sf_dir):
    """The same expression on a stream, run over what is there."""
    from tagloom.streaming.decode import decode_stream, run_available

    kind = record(field("event_id", "bigint"), field("user_id", "bigint"), field("event_type", "string"), field("value", "double"))
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    docs = rows.select(written(kind, row(kind)).alias("doc"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"{shared or 'file:///tmp/tagloom-streams'}/stream-{uuid.uuid4().hex}"
    return run_available(decode_stream(docs, "doc", kind)[0], f"{at}/out", f"{at}/state")
