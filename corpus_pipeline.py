"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents; the last one returns the sequences' pieces. Between stages the rows are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm.exact_dedup import dedup_stage
from crosspanel.llm.minhash import near_stage
from crosspanel.llm.packing import packing_stage
from crosspanel.llm.perplexity import quality_stage
from crosspanel.llm.pii import pii_stage
from crosspanel.llm.shared import Scratch

STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", dedup_stage),
    ("near dedup", near_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Perplexities, MinHash components and token ids have no SQL form; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage_{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
