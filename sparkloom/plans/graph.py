"""Cutting lineage, and connected components of an edge list."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (not yet made) in the one that the cluster shares and names in spark.checkpoint.dir.

    Only a single-machine session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` (eagerly) in the shared folder."""
    shared_folder(df.sparkSession, "checkpoint")
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: what rounds hand on to each other.

    A checkpoint keeps the estimate of its plan's size. Joins multiply estimates, so that in a loop the number's digits
    grow by a factor every round, and after some ten rounds planning takes longer than the work. A table's size is known.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long) by large-star and small-star steps.

    Returns node, component (the smallest node reachable) for every node of an edge. Each round is two grouped
    minimum aggregations over the edge list, with partial aggregation on the map side, so that a node with very
    many neighbours never meets in one task; the list is checkpointed each round and ends as stars.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour joins the smallest of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: the smaller neighbours and the node itself join the smallest of them
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_low, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("p")
        ).select("p.a", "p.b").where("a <> b").distinct()
        nxt = cut(small)
        # ended: every node hangs on one other node, and none of those hangs itself
        heads = nxt.select(F.col("a").alias("b")).distinct()
        done = nxt.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).union(
            nxt.join(heads, "b", "left_semi").select("b", F.lit(1).alias("n")).limit(1)
        ).count() == 0
        e = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
