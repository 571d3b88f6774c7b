"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space, and 09 to 0D).
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that materialize() wrote and release() has not deleted, by session.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.  Where that is unset, a
    single machine gets a temporary folder, once for the session; a cluster, an error,
    since no folder of one machine is seen by the others."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df once to the shared folder and reads it back: what follows no
    longer depends on shuffle files or cached blocks of executors that may die.

    Shuffle files of steps before are deleted first: Spark does so once the driver's
    collector finds that nothing refers to them, which else may be long after."""
    spark = df.sparkSession
    spark._jvm.System.gc()
    at = f"{shared_dir(spark)}/tagloom/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(at)
    _written.setdefault(spark.sparkContext.applicationId, []).append(at)
    return spark.read.schema(df.schema).parquet(at)


def written(spark: SparkSession) -> list[str]:
    """The intermediate tables that this application wrote and that still lie there."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, tables: list[str] | None = None) -> None:
    """Deletes intermediate tables (all if none are named).  Only for those that no
    result still to be computed reads."""
    held = _written.get(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for at in written(spark) if tables is None else tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(hadoop).delete(path, True)
        if at in held:
            held.remove(at)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_user(docs: DataFrame) -> DataFrame:
    """user (a struct of docs' columns, whatever their names) and row, the row's key:
    operators add columns beside user, so none of their names can clash with docs'."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("user"), row_key("doc_id", "text").alias("row"))


def of_user(columns: list[str]) -> list[Column]:
    """docs' columns again, out of user."""
    return [F.col("user")[c].alias(c) for c in columns]


def text_of(column: str = "text") -> Column:
    """The whole text; a null text is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def row_key(*columns: str) -> Column:
    """Names a row by 128 bits of hashes of its contents, so that rows which share an
    id but not a text stay apart and rows equal in both share their fate."""
    own = [F.col(c) for c in columns]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("second"), *own).alias("b"))


def ranked(df: DataFrame, group: list[str], order: list[str], size: str | None = None) -> DataFrame:
    """Adds __row (gapless from 0 within the group, by order), and with size also
    __before, the sum of size over the group's earlier rows, and __total, over all.

    Rows are dealt by range of (group, order), each partition's totals are summed to
    a table of one row per partition and group, and offsets from that table are
    added to ranks counted inside each partition.  No task sees a whole group.
    Equal rows may take each other's places; an arrival number breaks such ties, so
    no key, however frequent, needs to fit one partition."""
    dealt = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*group, *order, "__tie"]
    dealt = materialize(dealt.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    amount = F.sum(size) if size else F.lit(None).cast("long")
    totals = dealt.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), amount.alias("__s"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__g_{g}") for g in group],
        F.col("__part").alias("__at"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"),
        F.sum("__s").over(Window.partitionBy(*group)).alias("__total"),
    )
    match = F.col("__part") == F.col("__at")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    # one row per partition and per group that ends in it: bounded by partitions + groups
    joined = dealt.join(F.broadcast(offsets), match)
    inside = Window.partitionBy("__part", *group).orderBy(*order, "__tie")
    out = joined.withColumn("__row", F.col("__n0") + F.row_number().over(inside) - 1)
    if size:
        sums = inside.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__before", F.col("__s0") + F.coalesce(F.sum(size).over(sums), F.lit(0)))
    else:
        out = out.drop("__total")
    return out.drop("__tie", "__part", "__at", "__n0", "__s0", *[f"__g_{g}" for g in group])
