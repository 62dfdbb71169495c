"""The corpus pipeline: documents through quality, line, near-duplicate and substring filters into packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import stages
from millrace.llm.common import shared_dir

STAGES = [
    ("quality_classifier", stages.quality),
    ("line_dedup", stages.lines),
    ("minhash_near_dedup", stages.near),
    ("substring_dedup", stages.substrings),
    ("packing", stages.packing),
]

#: A trained classifier and a tokenizer stand in the way of SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
