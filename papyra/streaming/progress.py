"""How far uploads are: from the counts by status that each commit leaves in a store's log, and from what a stream's batches say of themselves.

Nothing here looks at documents but poll(), which looks at those it is asked for.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from papyra.functions import vocabulary as v
from papyra.streaming.store import MOST_STALE, Store

LOG = "version long, add map<string,string>, counts map<string,long>"
ARRIVALS = "stream string, number long, files long, bytes long, refused long, millis long"


def _staged(log: DataFrame) -> DataFrame:
    """version, upload, stage and counts of the commits of batches; batches that were no ingest's have stage null."""
    batch = F.element_at(F.map_keys("add"), 1)
    stage = F.regexp_extract(batch, "^[st].*-([0-3])$", 1).try_cast("int")
    upload = F.when(stage.isNull(), batch).otherwise(F.regexp_replace(batch, "-[0-3]$", ""))
    return log.where("size(add) = 1 AND size(counts) > 0").select("version", upload.alias("upload"), stage.alias("stage"), "counts")


def _by_status(staged: DataFrame) -> DataFrame:
    return staged.select("version", "upload", "stage", F.explode("counts").alias("status", "documents"))


def history(store: Store) -> DataFrame:
    """version, upload, stage, status and documents: how many documents of each status each commit wrote. A store without a log has no rows."""
    if not store.entries():
        return _by_status(_staged(store.spark.createDataFrame([], LOG)))
    return _by_status(_staged(store.spark.read.schema(LOG).json(f"{store.path}/log")))


def watch(store: Store) -> DataFrame:
    """history() as a stream of commits as they come, for a store that has a log already."""
    return _by_status(_staged(store.spark.readStream.schema(LOG).json(f"{store.path}/log")))


def uploads(store: Store) -> DataFrame:
    """One row for each upload, by its last commit: documents, complete, failed, in_progress, percent of those that are done, finished.

    Files that were refused count from the commit that knows them; what was deleted since still counts.
    """
    of = lambda *statuses: F.coalesce(F.sum(F.when(F.col("status").isin(*statuses), F.col("documents"))), F.lit(0))
    every = history(store)
    last = every.groupBy("upload").agg(F.max("version").alias("version"))
    counts = every.join(last, ["upload", "version"]).groupBy("upload", "version").agg(F.max("stage").alias("stage"), F.sum("documents").alias("documents"), of("analysis_complete").alias("complete"), of("failed").alias("failed"))
    counts = counts.withColumn("in_progress", F.col("documents") - F.col("complete") - F.col("failed"))
    done: Column = F.col("documents") - F.col("in_progress")
    return counts.withColumns({"percent": F.floor(100 * done / F.col("documents")).cast("int"), "finished": F.col("in_progress") == 0})


def poll(store: Store, ids: DataFrame | list[int]) -> DataFrame:
    """id, filename, status, its label, detail, and for failed ones why, of these documents; those that are deleted or unknown have no row."""
    snapshot = store.snapshot()
    if not snapshot.batches:
        return store.spark.createDataFrame([], "id long, filename string, status string, status_label string, status_detail string, error string")
    wanted = (ids.select("id") if isinstance(ids, DataFrame) else store.spark.createDataFrame([(i,) for i in ids], "id long")).distinct()
    few = wanted.limit(MOST_STALE + 1).count() <= MOST_STALE
    rows = store.rows(snapshot).join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    error = F.when(F.col("status") == "failed", F.when(F.col("error_message") != "", F.col("error_message")).otherwise("Processing failed."))
    return rows.select("id", "filename", "status", v.status_label(F.col("status")).alias("status_label"), "status_detail", error.alias("error"))


def _metric(path: str) -> str:
    return f"arrived_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:16]}"


def observed(files: DataFrame, refused: Column, path: str) -> DataFrame:
    """A stream of files that says of each batch how many files and bytes came, and how many of the files are refused."""
    return files.observe(_metric(path), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(refused).alias("refused"))


class ArrivalLog(StreamingQueryListener):
    """Writes what observed() says of the streams into one store, a file for each batch; batches in which nothing came have none.

    Spark tells a listener after a batch, so the driver's loss in between costs such a file, never a document.
    """

    def __init__(self, store: Store):
        self.store, self.name = store, _metric(store.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        got = progress.observedMetrics.get(self.name)
        if got is None or not got["files"]:
            return
        row = {"stream": str(progress.id), "number": progress.batchId, **{n: got[n] for n in ("files", "bytes", "refused")}, "millis": progress.batchDuration}
        self.store._put(f"{self.store.path}/arrivals/{row['stream']}-{row['number']:012d}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def arrivals(spark: SparkSession, store: Store) -> DataFrame:
    """What an ArrivalLog wrote: stream, number of the batch, files, bytes, refused and millis that the batch took."""
    if not store._names("arrivals"):
        return spark.createDataFrame([], StructType.fromDDL(ARRIVALS))
    return spark.read.schema(ARRIVALS).json(f"{store.path}/arrivals")
