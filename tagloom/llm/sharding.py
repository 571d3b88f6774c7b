"""Contiguous shards of near-equal bytes.

Documents are taken in the order of doc_id.  Global byte prefix sums come from
per-partition totals plus a running sum inside each partition; the line of all
bytes is cut at equal targets and a document belongs to the piece that holds its
middle, so every shard's bytes differ from the target by less than one document.

Cases: a null text counts no bytes (its row still costs `overhead`); rows that
repeat an id, or share a null id (first in order), are ordered by text checksum and
are otherwise interchangeable; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ranked, text_of


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    law is `bytes`: shard sizes are near equal; grown_shard is null because that
    law moves rows between all shards when their number changes."""
    text = text_of()
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = ranked(sized, [], ["doc_id", "text_crc32"], "size")
    middle = 2 * F.col("__before") + F.col("size")
    placed = placed.withColumn(
        "shard",
        F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("__total")))).cast("int"),
    )
    first = placed.groupBy(F.col("shard").alias("__shard")).agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(first), F.col("shard") == F.col("__shard")).select(  # `shards` rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__row") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
