"""The corpus pipeline: each stage reads what the one before it wrote, and writes for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.common import read, stored
from tidewire.llm.decontaminate import decontamination_stage
from tidewire.llm.mixing import mixing_stage
from tidewire.llm.sharding import shard_stage
from tidewire.llm.simhash import simhash_stage
from tidewire.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", shard_stage),
]

ORACLE_SQL = None    # boosted trees can't be stated in SQL; the tests use a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages: what is left, with its shard."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
