"""What the operators of this subpackage share: reading, batches, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.plans.workers import checkpointed, small_batches

__all__ = ["checkpointed", "map_batches", "out", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches that stay small whatever the length of the texts."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def out(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
