"""The corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from voxstrata.llm import bpe, decontaminate, line_dedup, near_dup, quality
from voxstrata.llm.common import Scratch, table

#: Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next.
STAGES = [
    ("quality", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", partial(near_dup.stage, similar=80)),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: The quality classifier is a fitted model, which SQL can't express: the stages are tested one by one by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; what each returns goes through the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
