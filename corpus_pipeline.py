"""The corpus pipeline: STAGES in order, each reading what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, language_id, near_dedup, packing, secrets
from siltstone.llm.common import cleanup, mark, stored, table

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("secret_scan", secrets.stage),
    ("packing", packing.stage),
]

#: Language models, sampling and tokenization can't be said in SQL; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of documents. Tables that led to a stage's result go once that is written."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        cleanup(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
