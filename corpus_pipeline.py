"""Whole-corpus preparation as a list of stages; each stage's result is written and read again by the next.

Toxic documents go, one document of each group of near copies stays, personal data is masked, sources are mixed to
their target weights, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import stages
from orderloom.sources.stage import StageTables

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("jaccard", stages.drop_near_copies),
    ("pii", stages.mask_personal_data),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

# Learned decisions, a random draw and token ids have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the last stage's rows."""
    kept = StageTables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = kept.keep(name, apply(spark, docs, sf_dir))
    return docs
