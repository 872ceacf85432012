"""The corpus pipeline: each stage takes what the one before kept.

A stage is (spark, docs, sf_dir) -> DataFrame over all of `docs`. All but the last return the
columns of `documents`; the last returns the mix, one row per document that it takes, with
copies. Every operator's handling of nulls, empty and repeated rows holds; a row without id is
never a near duplicate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.session import shared_folder

STAGES = [
    ("toxicity", stages.without_toxic),
    ("line dedup", stages.without_repeated_lines),
    ("near duplicates", stages.one_of_each),
    ("decontamination", stages.without_benchmark),
    ("mix", stages.mixed),
]

# a trained classifier decides in the first stage, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    return docs
