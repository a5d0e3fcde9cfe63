"""From raw documents to packed sequences: quality rules, near-duplicate removal, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import common, stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("minhash_near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("best_fit_packing", stages.best_fit_packing),
]

#: Packing and connected near duplicates are no SQL; tests/llm holds the result against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        after = common.saved(stage(spark, docs, sf_dir), name)
        common.dropped(docs)  # what the stage read; the input table is none of ours
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
