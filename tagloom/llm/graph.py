"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, release, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root (the smallest node it reaches) for every node of links(a, b).

    Every round points nodes at the smallest neighbour, first from above, then from
    below, until nothing changes (an error if `rounds` are not enough): a few rounds for a chain of any length, since paths
    halve.  Neighbourhoods are never gathered: minima are pre-aggregated and joined
    back, so a node with very many links spreads over tasks.  Each round's table is
    written, which also cuts its lineage; the tables of the round before are deleted."""
    spark = links.sparkSession
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        mine, others = written(spark)[-1], written(spark)[:-1]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written, so that each join has exchanges of its own, which split at a hub
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a != b").distinct())
        release(spark, [mine, *[t for t in written(spark)[:-1] if t != mine and t not in others]])
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
