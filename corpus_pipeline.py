"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, and
an empty table, which gives an empty one. All but the last return the columns they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skarn.llm.jaccard import one_of_each
from skarn.llm.packing import pack
from skarn.llm.pii import sanitise
from skarn.llm.quality import kept_rows
from skarn.llm.queries import vocabulary
from skarn.llm.radix_dedup import drop_duplicates
from skarn.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged alone; a null or empty text has no words and goes."""
    return kept_rows(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (null: empty), that with the largest id; a null id stays only if its equals have none, of repeated rows one."""
    return drop_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id (of one id, the text of the smallest hash); texts without words all stay."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced in their texts; a null text stays null, repeated rows are treated alike."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens; a null text is one end token, repeated rows are packed each."""
    return pack(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: Packing and tokens have no SQL; tests/llm/test_pipeline.py holds the rows against all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
