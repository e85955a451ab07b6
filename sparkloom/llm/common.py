"""Small helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import components, cut, shared_folder

__all__ = ["BATCH_ROWS", "NULL_ID", "components", "cut", "fan_out", "keyed", "matched", "stored", "table"]

#: Stands for a null doc_id inside an operator: later than every real id.
NULL_ID = (1 << 63) - 1


#: Rows of a batch between Spark and Python. Texts are long: this bounds what a task's two sides hold at once.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts or vectors; from now on the session sends them to Python in batches of few rows."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, and the key (_id, _th) of a row: the id with null made sortable, and a hash of the text.

    Rows that repeat both id and text share a key, and so a result. All other columns go, whatever their names.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64("text").alias("_th"),
        *more,
    )


def fan_out(spark: SparkSession, least: int = 1) -> int:
    """Partitions to deal rows into when an operator deals them itself."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: like a checkpoint, but compressed and read by column."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def matched(rows: DataFrame, keys: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """Inner join of `rows` with `keys`, a stored table of distinct `key` and `c`, the rows of `rows` that hold it.

    Keys of over 1/`most` of all those rows, of which there are fewer than `most`, are broadcast to deal their rows out
    over salts, as many as the key's count asks for: no task gets more than about that share of one key, however many
    rows it has, and all salts together are fewer than 2 * `most`. `rows` is read once.
    """
    bar = max(10_000, -(-(keys.agg(F.sum("c")).first()[0] or 0) // most))
    spread: Column = F.ceil(F.col("c") / bar).cast("int")
    salts = F.broadcast(keys.where(F.col("c") >= bar).select(key, spread.alias("_spread")))
    dealt = rows.join(salts, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), "_spread"), F.lit(0)).cast("int")).drop("_spread")
    every = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("c") >= bar, spread - 1).otherwise(0))))
    return dealt.join(every, [key, "_salt"]).drop("_salt")
