"""Secret scans with multipart credential linking.

Every text is searched for the parts of a credential.  Strong parts (assigned
secrets, access identifiers, long hexadecimal runs) are always reported.  Weak ones
are ordinary strings on their own: identifiers of accounts, long mixed tokens and
endpoints.  They are reported only where complementary parts stand within `scope`
code points in the same text:

  identifier  a secret (assigned, hexadecimal or token)
  token       an identifier (access or weak)
  endpoint    both an identifier and a secret

This interval join is a range frame over each text's parts, so no pair of parts is
ever formed.  A regular expression's matches get their places from the lengths of the
pieces between them, summed over the match number; nothing but the matches is dealt.

Cases: null and empty texts have no spans; a token that overlaps a strong part is not
a part of its own; each row is scanned by itself, so repeated rows report alike; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import text_of

#: Kind, expression, least length, group that must have it.
PARTS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("identifier", r"(?:ASIA|AIDA|AROA|ANPA)[A-Z0-9]{12,}|(?i:client_id|user|login|account)\x20*[:=]\x20*[A-Za-z0-9_.@-]{3,}", 4, 0),
    ("token", r"[A-Za-z0-9+/]{32,}={0,2}", 32, 0),
    ("endpoint", r"(?:https?|jdbc|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9._:/@%?&=-]+", 10, 0),
]
STRONG = ("assign", "access", "hex")


def _matches(rank: int, kind: str, expression: str, least: int, group: int) -> Column:
    """The text's matches of one kind, in order, each with the length of the piece
    before it; matches that fail stay, since later places count them."""
    found = F.regexp_extract_all("text", F.lit(expression), F.lit(0))
    pieces = F.split("text", expression, -1)
    tested = F.regexp_extract_all("text", F.lit(expression), F.lit(group)) if group else found
    rows = F.transform(
        F.arrays_zip(found.alias("m"), tested.alias("t"), pieces.alias("p")),
        lambda z, i: F.struct(
            F.lit(rank).alias("rank"),
            i.alias("i"),
            F.length(z["p"]).alias("gap"),
            F.length(z["m"]).alias("len"),
            (z["m"].isNotNull() & (F.length(z["t"]) >= least) & (z["t"].rlike("[0-9]") if kind == "token" else F.lit(True))).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<rank:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(F.col("text").rlike(expression), rows).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """doc_id and __row for every row of docs, with rank, start and end of each part;
    one row with a null rank for each text."""
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), text_of().alias("text"))
    found = F.concat(F.array(F.lit(None).cast("struct<rank:int,i:int,gap:int,len:int,ok:boolean>")), *[_matches(k, *p) for k, p in enumerate(PARTS)])
    each = texts.select("doc_id", "__row", F.explode_outer(found).alias("m")).select("doc_id", "__row", "m.*")
    so_far = Window.partitionBy("__row", "rank").orderBy("i")
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(so_far)
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    return spans.where("rank is null or ok").select("doc_id", "__row", "rank", "start", "end")


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_linked (weak parts that were linked)."""
    rank = {name: k for k, (name, *_) in enumerate(PARTS)}
    has = lambda *names: F.col("rank").isin([rank[n] for n in names])
    found = parts(docs)
    before = Window.partitionBy("__row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("__row").orderBy("start", "rank").rowsBetween(1, Window.unboundedFollowing)
    strong = has(*STRONG)
    found = found.withColumn(
        "covered",
        (F.coalesce(F.max(F.when(strong, F.col("end"))).over(before), F.lit(-1)) > F.col("start"))
        | (F.coalesce(F.min(F.when(strong, F.col("start"))).over(after), F.lit(2**62)) < F.col("end")),
    ).where(F.col("rank").isNull() | strong | ~F.col("covered"))
    near = Window.partitionBy("__row").orderBy("start").rangeBetween(-scope, scope)
    count = lambda what: F.sum(F.when(what, 1).otherwise(0)).over(near) > 0
    found = found.withColumns({"ids": count(has("access", "identifier")), "secrets": count(has("assign", "hex", "token"))})
    linked = (has("identifier") & F.col("secrets")) | (has("token") & F.col("ids")) | (has("endpoint") & F.col("ids") & F.col("secrets"))
    kind = F.element_at(F.array(*[F.lit(n) for n, *_ in PARTS]), F.col("rank") + 1)
    said = F.struct("start", "rank", F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    joined = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(what, said))), lambda s: s["said"]), ",")
    number = lambda what: F.count(F.when(what, 1))
    return (
        found.groupBy("__row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            *[number(has(n)).alias(f"n_{n}") for n in STRONG],
            F.sha2(joined(strong).cast("binary"), 256).alias("base_sha256"),
            joined(strong | linked).alias("spans"),
            number(linked).alias("n_linked"),
        )
        .drop("__row")
    )
