"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import read, text_of
from tagloom.llm.oracles import LINES, SECRETS, SUFFIX


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.media import text_media

    return text_media(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tagloom.llm.tokens import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.suffix import dedup_suffixes

    return dedup_suffixes(read(spark, sf_dir, "documents"), full=False)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.secrets import scan

    return scan(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.decontam import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row_key")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.toxicity import fold_of, learn, scored

    docs = read(spark, sf_dir, "documents")
    lexicon = learn(docs, read(spark, sf_dir, "labels"), fold_of() != 0)
    return scored(docs.select("doc_id", "text"), lexicon).select(
        "doc_id",
        F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.linededup import dedup_lines

    found = dedup_lines(read(spark, sf_dir, "documents"), report=True)
    return found.select(
        "doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(text_of().cast("binary"), 256).alias("kept_sha256")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.sharding import byte_shards

    return byte_shards(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.simhash import near_groups

    return near_groups(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_media, op2_packing, op3_tokens, op4_suffix_dedup, op5_secrets, op6_decontamination, op7_toxicity, op8_line_dedup, op9_sharding, op10_simhash)
}
ORACLES: dict[str, str] = {"op4_suffix_dedup": SUFFIX, "op5_secrets": SECRETS, "op8_line_dedup": LINES}
