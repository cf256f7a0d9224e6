"""From raw documents to token ids: rules, near copies, benchmark leaks, secrets, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalogq.llm import stages
from catalogq.llm.scratch import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontaminate),
    ("secret_scan", stages.mask_secrets),
    ("sentencepiece", stages.encode),
]

# The near-copy, contamination and encoding stages can't be stated in SQL over whole texts.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
