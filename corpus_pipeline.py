"""A training-data pipeline over `documents`: reject toxic texts, drop repeated lines, keep one of each group of near
copies, drop passages that an earlier document holds, and pack what is left into token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is the next one's docs; all but the last return the
columns of documents.

Defined cases: null texts stay null and empty ones empty through all stages but packing, where both are one end token;
rows with a null doc_id stay, and count as later than every other; rows that repeat id and text all stay or lose the
same; of documents that are copies of each other the smallest id stays, and ties can't arise beyond that; extra columns
go along, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import fmindex, jaccard, lines, packing, toxicity
from sparkloom.llm.common import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier predicts toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in blocks that align with an earlier document go."""
    return lines.dedup_text(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with Jaccard similarity of 0.8 or more over five-word shingles stays."""
    return jaccard.keep_one(docs, percent=80, width=5)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 50 that an earlier document holds go."""
    return fmindex.dedup_text(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("packing", pack),
]

#: The stages' models, alignments and tokenizer can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
