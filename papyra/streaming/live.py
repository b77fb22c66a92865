"""Changes of a store between versions, and key figures that follow them.

The log says which batches came and went and which rows are gone, so a change
costs what changed, not what is there: no state is kept for each document. A
compaction changes no document and is skipped.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.functions import vocabulary as v
from papyra.plans.workers import remove
from papyra.streaming.store import MOST_STALE, Snapshot, Store

KEYS = ("status", "department", "priority")
#: Sums for each combination of the keys, of which the vocabularies allow some hundreds.
SUMS = {"documents": "1", "pages": "page_count", "actions": "greatest(size(actions), 0)"}
STATE = "version long, rows array<struct<status:string,department:string,priority:string,documents:long,pages:long,actions:long>>"


def _between(store: Store, old: Snapshot, new: Snapshot) -> list[DataFrame]:
    """Rows with change 1 or -1 between versions without a compaction in between."""
    came, went = ([b for b in x.batches if b not in y.batches] for x, y in ((new, old), (old, new)))
    parts = [store.rows(of, batches).withColumn("change", F.lit(by)) for of, batches, by in ((new, came, 1), (old, went, -1)) if batches]
    late = tuple(g for g in new.gone if g not in old.gone)
    if late:
        gone = store.gone(Snapshot(gone=late)).select("batch", "ord")
        held = [b for b in new.batches if b in old.batches]
        touched = [r["batch"] for r in gone.where(F.col("batch").isin(*held)).select("batch").distinct().collect()]
        if touched:
            few = new.n_gone - old.n_gone <= MOST_STALE
            rows = store.rows(Snapshot(new.version, new.batches), touched)
            parts.append(rows.join(F.broadcast(gone) if few else gone, ["batch", "ord"], "left_semi").withColumn("change", F.lit(-1)))
    return parts


def changes(store: Store, since: int, until: int | None = None) -> DataFrame:
    """Documents that came to count after version since (change 1) or ceased to (-1), up to version until, with all their columns; one that was replaced has a row of each kind.

    Versions whose folders are purged cannot be read (AnalysisException). Nothing changed: no rows, and perhaps no columns but change.
    """
    entries = store.entries()
    until = entries[-1]["version"] if until is None and entries else until or 0
    compactions = [e["version"] for e in entries if e["base"] and since < e["version"] <= until]
    cuts = [since, *(x for c in compactions for x in (c - 1, c)), until]
    parts: list[DataFrame] = []
    for first, last in zip(cuts[::2], cuts[1::2], strict=True):
        if first < last:
            parts += _between(store, store.snapshot(first) if first else Snapshot(), store.snapshot(last))
    if not parts:
        return store.spark.createDataFrame([], "change int")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _summed(rows: DataFrame) -> DataFrame:
    """The sums of changes by the keys; columns that a store lacks count as null."""
    for name, kind in {**dict.fromkeys(KEYS, "string"), "page_count": "int", "actions": "array<string>"}.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.groupBy(*KEYS).agg(*[F.coalesce(F.sum(F.col("change") * F.expr(sql)), F.lit(0)).cast("long").alias(n) for n, sql in SUMS.items()])


def _states(store: Store, target: str) -> list[int]:
    _, path, fs = store._hadoop(target)
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path)) if fs.exists(path) else []


def _state(spark: SparkSession, target: str, version: int) -> DataFrame:
    return spark.read.schema(STATE).json(f"{target}/{version:012d}.json").select(F.inline("rows"))


def refresh(store: Store, target: str) -> int:
    """Figures at target brought to the store's version as it is now, which is given back; a purge of what they lag behind has them counted anew.

    A version's figures are one file that appears whole; the last two are kept, so that who reads one can end.
    """
    spark, target = store.spark, target.rstrip("/")
    known, now = _states(store, target), store.snapshot()
    last = known[-1] if known else 0
    if last >= now.version:
        return last
    found = None
    if last:
        try:
            both = _state(spark, target, last).unionByName(_summed(changes(store, last, now.version)))
            found = both.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in SUMS])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if found is None:
        found = _summed(store.rows(now).withColumn("change", F.lit(1)) if now.batches else spark.createDataFrame([], "change int"))
    rows = [r.asDict() for r in found.where("documents <> 0").collect()]
    store._put(f"{target}/{now.version:012d}.json", json.dumps({"version": now.version, "rows": rows}))
    for version in known[:-1]:
        remove(spark, f"{target}/{version:012d}.json")
    return now.version


def follow(store: Store, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A stream of the store's log that keeps the figures at target up to date, whoever writes. Run again after a failure it goes on from the figures that are there."""
    log = store.spark.readStream.schema("version long").json(f"{store.path}/log")

    def update(rows: DataFrame, number: int) -> None:
        refresh(Store(rows.sparkSession, store.path), target)

    writer = log.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def figures(store: Store, target: str) -> DataFrame:
    """version and the key figures of operators.facets.stats() as they are at target; of a target without figures those of nothing, version 0."""
    target = target.rstrip("/")
    known = _states(store, target)
    rows = _state(store.spark, target, known[-1]) if known else store.spark.createDataFrame([], STATE).select(F.inline("rows"))
    complete = F.col("status") == "analysis_complete"
    of = lambda name, condition=F.lit(True): F.coalesce(F.sum(F.when(condition, F.col(name))), F.lit(0)).alias(name)
    found = rows.agg(
        of("documents").alias("total_documents"), of("documents", complete).alias("complete"), of("documents", F.col("status") == "failed").alias("failed"),
        of("documents", complete & (F.col("priority") == "High")).alias("high_priority"),
        F.count_distinct(F.when(~F.col("department").isin("", v.UNASSIGNED), F.col("department"))).alias("departments"),
        of("pages"), of("actions", complete),
    )
    found = found.withColumn("in_progress", F.col("total_documents") - F.col("complete") - F.col("failed"))
    return found.select(F.lit(known[-1] if known else 0).cast("long").alias("version"), "*")
