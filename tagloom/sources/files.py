"""Documents in files: one document per binary file, or a column of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_document_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified and doc for every file; each file is one document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("content").alias("doc"))


def stream_document_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same as a stream of the files that arrive."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("content").alias("doc"))


def write_documents(df: DataFrame, path: str, mode: str = "error") -> None:
    """A table with document columns, as Parquet."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def slice_bytes(doc, start, size):
    """The bytes from `start` (0-based) on, as a reader that keeps what it passes sees them."""
    return F.substring(doc, start + 1, size)
