"""The corpus pipeline: language ID, near-dedup, decontamination, secret masking, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run`` writes
each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import written
from tickloom.llm.langid import language_stage
from tickloom.llm.leaks import leak_stage
from tickloom.llm.mixing import mix_stage
from tickloom.llm.neardup import dedup_stage
from tickloom.llm.secrets import secret_stage

STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", leak_stage),
    ("secret_scan", secret_stage),
    ("mixing", mix_stage),
]

#: The learned stages have no SQL form; tests/llm compares the pipeline's near-dedup with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
