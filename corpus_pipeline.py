"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes what a stage returns to
the folder that all executors share and reads it again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import common
from sparkveil.llm.exact_dedup import stage_exact_dedup
from sparkveil.llm.language_id import stage_language_id
from sparkveil.llm.mixing import stage_mixing
from sparkveil.llm.sentencepiece_stream import stage_sentencepiece
from sparkveil.llm.simhash import stage_simhash

STAGES = [
    ("language_id", stage_language_id),
    ("exact_dedup", stage_exact_dedup),
    ("simhash_near_dedup", stage_simhash),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_sentencepiece),
]

#: SQL can't express a trained classifier; tests/llm holds the decision of each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        since = common.made()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        common.release(since)  # the stage's own tables, and what it read
        if before is not None:
            scratch.free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
