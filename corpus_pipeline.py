"""Corpus pipeline: quality rules, near-duplicate join, decontamination, secret redaction, packing.

Each stage takes the documents that its predecessor kept, with all columns of
the documents table; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.decontaminate import decontaminate_stage
from tesserae.llm.ngram_join import near_duplicate_stage
from tesserae.llm.packing import packing_stage
from tesserae.llm.quality import quality_stage
from tesserae.llm.secrets import secrets_stage
from tesserae.llm.storage import documents, stored

STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontaminate_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]
#: SQL has no tokenizer, which the last stage needs; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
