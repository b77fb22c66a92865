"""Asking a model about documents: requests, bounded concurrency, retries, and a cache of replies by what was asked.

Equal requests are asked once. Replies are written as they come, to the cache's
folder, so a job that is run again asks only what has no reply yet; failures are not
kept. What a reply is worth is for rules.with_fallback() to say.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.plans.workers import shared_folder, small_batches

#: Fixed value: characters of a document's text that a model is shown.
MOST_CHARS = 60_000


def request(filename: str = "filename", text: str = "extracted_text", pages: str = "page_count") -> Column:
    """What a model is asked, as JSON: filename, page_count (null if unknown), truncated and text, the first 60,000 characters. Null for a document without text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    asked = F.to_json(F.struct(F.col(filename).alias("filename"), F.col(pages).alias("page_count"), (F.length(raw) > MOST_CHARS).alias("truncated"), F.left(raw, F.lit(MOST_CHARS)).alias("text")), {"ignoreNullFields": "false"})
    return F.when(t.trimmed(raw) != "", asked)


def _ask(ask: Callable[[str], str], one: str, attempts: int, wait: float) -> str:
    for n in range(attempts):
        try:
            return str(ask(one))
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("no attempts")


def answers(requests: DataFrame, ask: Callable[[str], str], workers: int = 4, attempts: int = 3, wait: float = 0.5, most_seconds: float = 120.0) -> DataFrame:
    """digest, reply and error (the kind of the last failure) of requests (digest, request). A task asks workers at a time; a request has most_seconds for all of its attempts, counted from when it is first waited for."""
    small_batches(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pool = ThreadPoolExecutor(workers)
            waiting = [pool.submit(_ask, ask, r, attempts, wait) for r in batch["request"].to_pylist()]
            found: list[tuple[str | None, str | None]] = []
            for one in waiting:
                try:
                    found.append((one.result(most_seconds), None))
                except Late:
                    one.cancel()
                    found.append((None, "TimeoutError"))
                except Exception as e:
                    found.append((None, type(e).__name__))
            pool.shutdown(wait=False, cancel_futures=True)
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["digest", "reply", "error"])

    return requests.select("digest", "request").mapInArrow(run, "digest string, reply string, error string")


def replies(df: DataFrame, ask: Callable[[str], str], cache: str | None = None, **options) -> DataFrame:
    """df with reply and error, null where nothing was asked. cache is a folder of earlier replies, which gets the new ones; without it they go to the session's shared folder."""
    spark = df.sparkSession
    folder = cache or f"{shared_folder(spark, 'replies-')}/replies-{uuid.uuid4().hex}"
    asked = df.withColumn("_digest", F.sha2(request(), 256))
    wanted = df.select(request().alias("request")).where("request IS NOT NULL").select(F.sha2("request", 256).alias("digest"), "request").dropDuplicates(["digest"])
    schema = "digest string, reply string, error string"
    try:
        known = spark.read.schema(schema).parquet(folder).where("reply IS NOT NULL").select("digest")
        wanted = wanted.join(known, "digest", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch = f"{folder}/batch={uuid.uuid4().hex}"
    answers(wanted, ask, **options).write.parquet(batch)
    every = spark.read.option("basePath", folder).schema(f"{schema}, batch string").parquet(folder)
    # Of a digest one reply, or this batch's failure.
    found = every.where((F.col("reply").isNotNull()) | (F.col("batch") == batch.rsplit("=", 1)[1])).groupBy(F.col("digest").alias("_digest")).agg(F.min("reply").alias("reply"), F.min("error").alias("error"))
    found = found.withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))
    return asked.drop("reply", "error").join(found, "_digest", "left").drop("_digest")
