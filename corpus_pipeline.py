"""The corpus pipeline: quality rules, near-dedup, decontamination, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and read
again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshloom.llm import decontaminate, neardup, packing, pii, quality
from meshloom.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.reject(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    return neardup.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to labels."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places in training sequences (``packing.sequences`` joins them)."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Robust estimates, sketches and tokenizers have no SQL form.
ORACLE_SQL = None
