"""Decoding streams: the same stateless expression, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.decode import decode


def decode_stream(stream: DataFrame, doc: str, kind: T.StructType, dialect: str = "native") -> tuple[DataFrame, DataFrame]:
    """The decoded fields of good documents, and the errors of the others, as streams."""
    both = stream.withColumn("__d", decode(F.col(doc), kind, dialect=dialect))
    good = both.where("__d.error is null").select("__d.value.*")
    bad = both.where("__d.error is not null").select(doc, "__d.error.*")
    return good, bad


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and reads its output."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
