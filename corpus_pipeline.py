"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Quality rules reject documents, near duplicates leave one document of each
group, personal data gives way to surrogates, and what is left is packed into
sequences. No SQL can express the near duplicates, so ORACLE_SQL is None.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from papyra.llm import near_dup, packing, pii, quality
from papyra.llm.queries import pii_secret
from papyra.plans.workers import remove, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, each row by the verdict on its own text."""
    return quality.kept_rows(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.first_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii_secret(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_stage), ("near duplicates", near_duplicates_stage), ("personal data", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir. Stages are written to spark.checkpoint.dir, in a local session without one to a temporary folder of its own; each is removed when the next is written, so that no text without surrogates stays."""
    folder = f"{shared_folder(spark, 'pipeline-')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return docs
