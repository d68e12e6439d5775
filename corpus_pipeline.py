"""Corpus clean-up: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads what it wrote.  All stages but the last keep the columns of documents.
Rows with a null text or doc_id pass through as their operators say: a null or
empty text is clean, alone and unmasked, and is packed as one end id; a row
without doc_id is in no group of copies and ranks last among passages.  Repeated
rows of one doc_id are one group of copies, so one of them stays.  Empty tables
stay empty; extra columns are kept up to packing, whatever their names.  Each stage
begins with heaps that gave back what the stage before it had freed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import scratch, slim
from auditlake.llm.jaccard import one_of_each
from auditlake.llm.packing import pack
from auditlake.llm.pii import mask_documents
from auditlake.llm.queries import vocabulary
from auditlake.llm.suffixes import without_passages
from auditlake.llm.toxicity import clean_documents

#: The stages' models and sets are not SQL; a test holds run() and each stage against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; without any label all of them."""
    slim(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 80 % similarity."""
    return one_of_each(docs, words=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document of smaller doc_id has."""
    slim(spark)
    return without_passages(docs, length=50)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null texts stay null."""
    slim(spark)
    return mask_documents(docs)


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of power-of-two lengths, without their ids: every id of every document is in one of them."""
    slim(spark)
    return pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("passages", cut_passages), ("personal data", mask_personal_data), ("packing", pack_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each result written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
