"""The corpus pipeline: five stages, each written and read again before the next.

Cases, in every stage: a null or empty text counts as a text without words (it is not
toxic, holds no item, and all such texts are near duplicates of each other); a null
doc_id is a document like any other and the last of its group; rows equal in doc_id and
text count once after near_dedup; very long texts are read whole; columns beside doc_id
and text come through unchanged (but n_chars, counted anew), whatever their names; an
empty table gives an empty one, and without labels or benchmark nothing is rejected.
"""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, read, release, written
from tagloom.llm.decontam import decontaminate
from tagloom.llm.linededup import dedup_lines
from tagloom.llm.packing import pack
from tagloom.llm.simhash import keep_one
from tagloom.llm.toxicity import fold_of, learn, scored

#: Stages learn and vote, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


#: Intermediate tables of the stage that ran last, by application and input.
_left: dict[tuple[str, str], list[str]] = {}


def _after(former: bool) -> Callable:
    """A stage; with former, it first deletes the intermediate tables of the stage before
    it.  A stage's docs are the written result of that one, so nothing reads them any
    more; the tables of the last stage stay, as its result may not be computed yet."""

    def of(stage: Callable) -> Callable:
        @wraps(stage)
        def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir)
            done = _left.pop(key, [])
            if former:
                release(spark, done)
            before = written(spark)
            out = stage(spark, docs, sf_dir)
            _left[key] = [at for at in written(spark) if at not in before]
            return out

        return clean

    return of


@_after(former=False)
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    lexicon = learn(docs, read(spark, sf_dir, "labels"), fold_of() != 0)
    name = "__score"
    while name in docs.columns:
        name += "_"
    return scored(docs, lexicon, name).where(F.col(name) < 0.5).drop(name)


@_after(former=True)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that occurred before are taken out of the texts."""
    return dedup_lines(docs)


@_after(former=True)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: op10's fingerprints and
    BK-trees find links, an exact check of shingles follows, and a join of sets adds the
    links that fingerprints miss."""
    return keep_one(docs)


@_after(former=True)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


@_after(former=True)
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mine: list[str] = []
    for _, stage in STAGES[:-1]:
        before = written(spark)
        docs = materialize(stage(spark, docs, sf_dir))
        # the stage's result is written whole, so its other tables and its input may go
        release(spark, [at for at in written(spark)[:-1] if at not in before or at in mine])
        mine = written(spark)[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
