"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import common, decontaminate, line_dedup, packing, quality, simhash

STAGES = [
    ("quality", quality.stage_quality),
    ("line_dedup", line_dedup.stage_line_dedup),
    ("simhash", simhash.stage_simhash),
    ("decontaminate", decontaminate.stage_decontaminate),
    ("packing", packing.stage_packing),
]

#: Packing and near-duplicate removal cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        # what a stage itself has staged goes once its output is written
        with common.released(spark) as kept:
            docs = common.stage(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
