"""The corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet in the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe_automaton import tokens_stage
from lectern.llm.containment import decontaminate_stage
from lectern.llm.language_id import language_stage
from lectern.llm.line_spread import lines_stage
from lectern.llm.near_dedup import near_dedup_stage
from lectern.llm.shared import stored

STAGES = [
    ("language identification", language_stage),
    ("line deduplication", lines_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("tokens", tokens_stage),
]

#: The last stage's encoding has no SQL form; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
