"""Removal of multi-line chunks that repeat anywhere in the corpus.

A text's lines are hashed, and a rolling hash over `window` neighbouring line hashes
ends a chunk after the lines where it is divisible by `divisor`.  Boundaries depend on
nearby lines only, so an insertion moves no boundary beyond its neighbourhood and a
passage is cut alike wherever it stands.  Chunks of two or more lines that occur again
are removed; the occurrence with the smallest doc_id, and there the earliest, stays.

Chunks are first counted by hash, without their texts.  Only documents that hold a
repeated hash send those chunks' texts on: per hash, the least and the greatest text
are compared byte by byte (both pre-aggregate, so a chunk that a third of all
documents share stays cheap).  Where they differ, hashes have collided and that hash's
chunks are grouped by their full text instead.

Cases: a null text has no lines and stays null; an empty text is one empty line;
documents keep their rows even if no line is left; rows equal in doc_id and text share
their fate, so neither is the other's repeat; null ids come first; an empty table
gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, of_user, with_user

PRIME = 2_147_483_647


def with_chunks(docs: DataFrame, window: int = 2, divisor: int = 3) -> DataFrame:
    """Adds __chunks, an array of (n, text) in order: n lines joined by line feeds."""
    g = F.transform("__lines", lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long") % PRIME)
    out = docs.withColumn("__lines", F.split("text", "\n")).withColumn("__g", g)

    def rolled(x: Column, i: Column) -> Column:
        total, power = x, 1
        for back in range(1, window):
            power = power * 31 % PRIME
            # an index before the first line counts as hash 0
            earlier = F.when(i >= back, F.get("__g", i - back)).otherwise(F.lit(0).cast("long"))
            total = total + earlier * power
        return total % PRIME % divisor == 0

    last = F.size("__g") - 1
    ends = F.filter(F.transform("__g", lambda x, i: F.when(rolled(x, i) | (i == last), i)), lambda e: e.isNotNull())
    out = out.withColumn("__ends", ends)

    def chunk(e: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get("__ends", k - 1) + 1).otherwise(F.lit(0))
        n = e - start + 1
        # not slice(), which copies the whole array each time
        lines = F.transform(F.sequence(start, e), lambda j: F.get("__lines", j))
        return F.struct(n.alias("n"), F.array_join(lines, "\n").alias("text"))

    # __lines is named twice so that it is computed before, not inside, the lambda
    chunks = F.when(F.size("__lines") >= 0, F.transform("__ends", chunk))
    return out.withColumn("__chunks", chunks).drop("__g", "__ends", "__lines")


def _flags(places: Column) -> Column:
    """Of ascending places, an array that is true there and false between."""
    def upto(place: Column, k: Column) -> Column:
        last = F.when(k > 0, F.get(places, k - 1)).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(False), place - last - 1), F.array(F.lit(True)))

    return F.flatten(F.transform(places, upto))


def marked(docs: DataFrame, window: int, divisor: int, key: Callable[[Column], Column]) -> DataFrame:
    """with_user(docs) with drop, the ascending places of chunks to remove (null if none)."""
    named = with_user(docs)
    chunked = with_chunks(named.select(F.col("user.doc_id").alias("doc_id"), "row", F.col("user.text").alias("text")), window, divisor)
    # outer: else a filter on the array's size is pushed down and computes it inside itself
    each = chunked.select("doc_id", "row", F.posexplode_outer("__chunks").alias("ix", "chunk")).where("chunk.n > 1")
    spots = materialize(each.select(key(F.col("chunk.text")).alias("h"), F.struct("doc_id", "row", "ix").alias("at")))
    firsts = spots.groupBy("h").agg(F.min("at").alias("first"), F.min("at").alias("low"), F.max("at").alias("high"))
    # written, so that the join has an exchange of its own, which splits at a frequent hash
    firsts = materialize(firsts.where("low != high").select("h", "first"))
    repeated = spots.join(firsts, "h")
    marks = repeated.groupBy(F.col("at.row").alias("mark")).agg(
        F.collect_set(F.struct(F.col("at.ix").alias("ix"), "h", (F.col("at") != F.col("first")).alias("later"))).alias("marks")
    )
    kept = materialize(named.join(marks, F.col("row") == F.col("mark"), "left").drop("mark"))
    plain = F.transform(F.filter("marks", lambda m: m["later"]), lambda m: m["ix"])

    texts = (
        with_chunks(kept.where("marks is not null").select(F.col("user.doc_id").alias("doc_id"), F.col("user.text").alias("text"), "row", "marks"), window, divisor)
        .select("doc_id", "row", "__chunks", F.explode("marks").alias("m"))
        .select("doc_id", "row", "m.ix", "m.h", F.get("__chunks", F.col("m.ix"))["text"].alias("chunk"))
    )
    collided = materialize(texts.groupBy("h").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a != b").select("h"))
    if collided.isEmpty():
        return kept.withColumn("drop", F.array_sort(plain))
    at = F.struct("doc_id", "row", "ix")
    doubtful = materialize(texts.join(collided, "h", "left_semi").withColumn("at", at))
    exact = doubtful.groupBy("h", "chunk").agg(F.min("at").alias("first"))
    again = doubtful.join(exact, ["h", "chunk"]).where("at != first").groupBy(F.col("row").alias("again")).agg(F.collect_set("ix").alias("more"))
    sure = (
        kept.select("row", F.explode("marks").alias("m")).where("m.later").select("row", "m.ix", "m.h")
        .join(collided, "h", "left_anti").groupBy(F.col("row").alias("sure")).agg(F.collect_set("ix").alias("plain"))
    )
    joined = kept.join(sure, F.col("row") == F.col("sure"), "left").join(again, F.col("row") == F.col("again"), "left")
    none = F.array().cast("array<int>")
    return joined.withColumn("drop", F.array_sort(F.array_union(F.coalesce("plain", none), F.coalesce("more", none)))).drop("plain", "more", "sure", "again")


def dedup_lines(
    docs: DataFrame, window: int = 2, divisor: int = 3, key: Callable[[Column], Column] = F.xxhash64, report: bool = False
) -> DataFrame:
    """docs with repeated multi-line chunks taken out of text (and n_chars, if there,
    counted anew).  report adds n_lines, n_removed_lines and n_removed_chunks, which
    docs must not have."""
    if report and (twice := {"n_lines", "n_removed_lines", "n_removed_chunks"} & set(docs.columns)):
        raise ValueError(f"docs have columns of the report: {', '.join(sorted(twice))}")
    found = marked(docs, window, divisor, key).select("user", F.col("user.text").alias("text"), "drop")
    touched = F.size(F.coalesce("drop", F.array().cast("array<int>"))) > 0
    # only documents that lose a chunk are cut into chunks again
    cut = with_chunks(found.where(touched), window, divisor).withColumn("gone", _flags(F.col("drop")))
    # gone is named twice so that it is computed before, not inside, the lambda
    left = F.when(F.size("gone") > 0, F.filter("__chunks", lambda c, i: ~F.coalesce(F.get("gone", i), F.lit(False))))
    cut = cut.withColumn("left", left).select(
        "user",
        F.array_join(F.transform("left", lambda c: c["text"]), "\n").alias("text"),
        F.aggregate("__chunks", F.lit(0), lambda n, c: n + c["n"]).alias("all"),
        F.aggregate("left", F.lit(0), lambda n, c: n + c["n"]).alias("kept"),
        F.size("drop").alias("cut"),
    )
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    lines = F.when(F.col("text").isNull(), 0).otherwise(lines)
    whole = found.where(~touched).select("user", "text", lines.alias("all"), lines.alias("kept"), F.lit(0).alias("cut"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        old = F.col("user")["n_chars"]
        changed["n_chars"] = F.when(F.col("cut") > 0, F.length("text")).otherwise(old).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    columns = [changed.get(c, own) for c, own in zip(docs.columns, of_user(docs.columns))]
    if report:
        columns += [
            F.col("all").cast("long").alias("n_lines"),
            (F.col("all") - F.col("kept")).cast("long").alias("n_removed_lines"),
            F.col("cut").cast("long").alias("n_removed_chunks"),
        ]
    return cut.unionByName(whole).select(columns)
