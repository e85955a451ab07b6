"""What the two classifiers share: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def teaching_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, characters: int) -> DataFrame:
    """doc_id, text, label of the first labelled teaching rows, in the order of a hash: at most `most` rows, and no more
    than reach `characters` characters together. Texts of any length teach, whole.

    Both bounds make it safe to broadcast the chosen keys and to fit on the driver. Rows are chosen by a hash of id and
    text, so the sample doesn't depend on partitions; equal rows teach once. An id with several labels counts with the
    largest.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = marks.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(most)
    texts = keyed(docs).where("text <> ''").select("_id", "_th", "text")
    sizes = texts.select("_id", "_th", F.length("text").alias("size")).join(F.broadcast(chosen), "_id").dropDuplicates(["_id", "_th"])
    first = sizes.withColumn("place", F.xxhash64("_id", F.lit(3))).orderBy("place", "_id", "_th").limit(most)
    before = F.sum("size").over(Window.orderBy("place", "_id", "_th").rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < characters).select("_id", "_th", "label")
    return texts.join(F.broadcast(first), ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select(F.col("_id").alias("doc_id"), "text", "label")
