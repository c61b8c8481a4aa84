"""Corpus pipeline: quality, near duplicates, repeated passages, secrets, packing.

Each stage takes what the one before it kept, as documents, and applies one operator of
`sedge.llm` to all of it. Stages are written as Parquet between each other by whoever runs
them one by one; `run` hands them on through the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import common, curve_packing, minhash_dedup, quality_crf, secret_scan, substring_dedup
from sedge.shipping import ship

STAGES = [
    ("quality_crf", quality_crf.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("secret_scan", secret_scan.stage),
    ("curve_packing", curve_packing.stage),
]

#: Classifier, sampling and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the folder's documents."""
    ship(spark)
    docs = common.documents(spark, sf_dir)
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.checkpointed(docs)
    return docs
