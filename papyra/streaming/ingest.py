"""Ingest of files into a store of documents, in batches or as a stream of new files.

A batch first lands its files, then commits its rows four times, each time in place
of the last: accepted, being read, read, analysed or failed. So readers see each stage,
and no half of one. A document's id follows from its path; a later batch stands in for
earlier rows of its ids. A batch that is run again after a failure goes on where it was,
and what was deleted or uploaded anew meanwhile stays so.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.functions import vocabulary as v
from papyra.operators import rules
from papyra.plans.workers import checkpointed, shared_folder
from papyra.sources import files as f
from papyra.streaming import progress
from papyra.streaming.store import LARGE_ROWS, Store

LOW_OCR = "OCR confidence is low; verify details against the original document."
#: Fields of a document before its file is read, and before its text is analysed.
UNREAD = {"extracted_text": "''", "extraction_method": "''", "language": "'Unknown'", "word_count": "0", "char_count": "0", "page_count": "CAST(NULL AS INT)", "ocr_used": "false", "ocr_quality": "CAST(NULL AS DOUBLE)", "error_message": "''", "processed_at": "CAST(NULL AS TIMESTAMP_NTZ)"}
_NONE = "CAST(array() AS array<string>)"
UNANALYSED = {
    "document_type": "''", "department": f"'{v.UNASSIGNED}'", "priority": "'Medium'", "summary": "''", "analysis_engine": "''", "analysis_error": "''", "analysis_confidence": "CAST(NULL AS DOUBLE)",
    **dict.fromkeys(("secondary_departments", "key_points", "keywords", "risks", "compliance_flags"), _NONE),
    "actions": "CAST(array() AS array<struct<action:string,owner:string,due_date:string,priority:string>>)", "deadlines": "CAST(array() AS array<struct<date:string,description:string>>)",
}


def _id() -> Column:
    return F.xxhash64("path")


def _now(as_of: datetime | None) -> Column:
    """An instant in UTC, to the microsecond."""
    if as_of is not None and as_of.tzinfo:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit((as_of or datetime.now(timezone.utc).replace(tzinfo=None)).isoformat(sep=" ")).cast("timestamp_ntz")


def _stored_name() -> Column:
    """A name by content, so that other bytes never stand under it."""
    return F.concat(F.substring("checksum", 1, 32), F.lit("_"), F.col("filename"))


def land(files: DataFrame, store: str, batch: str) -> DataFrame:
    """The files (path, length, content) written to the store and read from there; of refused ones no bytes are kept."""
    target = f"{store}/originals/batch={batch}"
    rows = files.select(_id().alias("id"), "path", "length", F.when(f.gate().isNull(), F.col("content")).alias("content"))
    rows.sortWithinPartitions("id").write.mode("overwrite").options(**LARGE_ROWS).parquet(target)
    return files.sparkSession.read.parquet(target).withColumn("landed", F.lit(batch))


def _landed(files: DataFrame) -> list[str]:
    """The column that says where the files' bytes are, if there is one."""
    return [c for c in files.columns if c == "landed"]


def unanalysed(rows: DataFrame) -> DataFrame:
    """rows with what a document is before its text is analysed, or where nothing was read: a title and a blob of its name."""
    return rows.withColumns({**{c: F.expr(sql) for c, sql in UNANALYSED.items()}, "title": t.title_from_filename(F.col("filename")), "search_blob": F.lower("filename")})


def waiting(files: DataFrame, uploaded_by: str = "", as_of: datetime | None = None, reading: bool = False, decoders=None) -> DataFrame:
    """Documents of files that are accepted but not read yet, or are being read. Refused files have no row."""
    rows = f.facts(files, *_landed(files)).where("refused IS NULL").drop("refused", "content")
    scanned = F.col("file_type").isin("PDF", "IMAGE") & F.lit(reading and "IMAGE" in (decoders or {}))
    rows = rows.withColumns({
        "id": _id(), "uploaded_by": F.lit(uploaded_by), "uploaded_at": _now(as_of), "stored_filename": _stored_name(),
        "status": F.when(scanned, "ocr_processing").otherwise("processing"),
        "status_detail": F.when(scanned, "Reading document (OCR enabled)").otherwise("Extracting text" if reading else "Queued for text extraction"),
        **{c: F.expr(sql) for c, sql in UNREAD.items()},
    })
    return unanalysed(rows)


def extracted(files: DataFrame, decoders=None, uploaded_by: str = "", as_of: datetime | None = None) -> DataFrame:
    """Documents of files that are read but not analysed yet. Refused files and those that cannot be read have failed: nothing is known of them but their names and why."""
    rows = f.extract(files, decoders, *_landed(files)).withColumns({"id": _id(), "uploaded_by": F.lit(uploaded_by), "uploaded_at": _now(as_of), "stored_filename": _stored_name()})
    failed = F.col("reason").isNotNull()
    low = F.coalesce(F.col("ocr_used") & (F.col("ocr_quality") < 70), F.lit(False))
    rows = rows.withColumns({
        "status": F.when(failed, "failed").otherwise("ai_analysis"),
        "status_detail": F.when(failed, "Text extraction failed").otherwise("Running AI analysis"),
        "error_message": F.left(F.when(failed, F.col("reason")).otherwise(F.concat_ws(" ", "warnings", F.when(low, LOW_OCR))), F.lit(1000)),
        "processed_at": F.lit(None).cast("timestamp_ntz"),
        **{c: F.when(~failed, F.col(c)).otherwise(F.expr(UNREAD[c])) for c in ("extraction_method", "language", "word_count", "char_count")},
    })
    return unanalysed(rows.drop("reason", "warnings"))


def analysed(rows: DataFrame, as_of: datetime | None = None, replies: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """extracted() documents analysed by the rules or by a model's replies; failed ones stay as they are.

    replies adds columns reply (JSON of a model) and error to the rows; without it the rules judge all.
    """
    failed = rows.where("status = 'failed'")
    read = rows.where("status <> 'failed'").drop("title", "search_blob", *UNANALYSED)
    if replies:
        read = rules.with_fallback(replies(read), "reply", "error").drop("reply", "error")
    else:
        read = rules.analysed(read).withColumns({"analysis_engine": F.lit("rule-based"), "analysis_error": F.lit("")})
    read = read.withColumns({
        "status": F.lit("analysis_complete"), "processed_at": _now(as_of),
        "status_detail": F.when(F.col("analysis_engine") == "model", "Analysed with a model").otherwise("Analysed with rule engine"),
    }).withColumn("search_blob", rules.search_blob())
    return read.unionByName(failed)


def documents(files: DataFrame, decoders=None, uploaded_by: str = "", as_of: datetime | None = None, replies: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """extracted() and analysed() in one plan."""
    return analysed(extracted(files, decoders, uploaded_by, as_of), as_of, replies)


def _write(files: DataFrame, store: Store, name: str, known: DataFrame | None = None, decoders=None, uploaded_by: str = "", as_of: datetime | None = None, replies=None) -> str:
    """All stages of a batch; gives the folder of the last.

    known has id, uploaded_by and uploaded_at of documents that keep them, and are the only ones to get rows.
    """
    as_of = as_of or datetime.now(timezone.utc)
    stages = [f"{name}-{n}" for n in range(4)]

    def put(n: int, rows: DataFrame) -> None:
        if known is not None:
            rows = rows.drop("uploaded_by", "uploaded_at").join(known, "id")
        must = F.lit(known is not None) if n == 0 else F.col("stored_filename").isNotNull() | F.lit(n == 3 or known is not None)
        store.add(stages[n], rows, stages[:n], only_known=must)

    put(0, waiting(files, uploaded_by, as_of))
    put(1, waiting(files, uploaded_by, as_of, reading=True, decoders=decoders))
    put(2, extracted(files, decoders, uploaded_by, as_of))
    if stages[3] not in store.snapshot().ever:
        rows = store.read("documents", [stages[2]]).drop("batch", "ord")
        store.add(stages[3], analysed(rows, None, replies), stages[:3], only_known=F.lit(True))
    return f"{store.path}/documents/batch={stages[3]}"


def _name() -> str:
    return f"t{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def ingest(spark: SparkSession, source: str, store: str, **options) -> str:
    """One batch of all files under source; gives the folder it wrote."""
    name = _name()
    return _write(land(f.read_files(spark, source), store, name), Store(spark, store), name, **options)


def _ids(spark: SparkSession, ids: DataFrame | list[int]) -> DataFrame:
    return ids.select("id") if isinstance(ids, DataFrame) else spark.createDataFrame([(i,) for i in ids], "id long")


def reprocess(spark: SparkSession, store: str, ids: DataFrame | list[int], **options) -> str:
    """One batch of these documents' bytes as they are in the store, whatever their number; the new rows stand in for the old and keep who uploaded them and when. Ids that are deleted or unknown have no row."""
    held = Store(spark, store)
    known = checkpointed(held.rows().select("id", "uploaded_by", "uploaded_at", "landed").join(_ids(spark, ids).distinct(), "id", "left_semi"))
    return _write(held.files(known), held, _name(), known.drop("landed"), **options)


def ingest_stream(spark: SparkSession, source: str, store: str, checkpoint: str, available_now: bool = True, **options):
    """The same for files as they arrive. Batches are named by the stream and their number, so that streams never meet, and one that is run again does not count twice."""
    reader = spark.readStream.format("binaryFile").schema(f.SCHEMA).option("recursiveFileLookup", "true").load(source)

    def write(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        name = f"s{hashlib.sha256(query.encode()).hexdigest()[:16]}-{number:012d}"
        held = Store(rows.sparkSession, store)
        if f"{name}-3" not in held.snapshot().ever:
            _write(land(rows, store, name), held, name, **options)

    writer = progress.observed(reader, f.gate().isNotNull(), store).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The latest row of each document that is not deleted."""
    return Store(spark, store).rows().drop("batch", "ord")


def delete(spark: SparkSession, store: str, ids: DataFrame | list[int]) -> None:
    """These documents are gone for whoever reads from now on; purge() of the store removes their rows and bytes."""
    Store(spark, store).delete(_ids(spark, ids))


def pages(rows: DataFrame) -> DataFrame:
    """The page table of documents: as the pages are part of their rows, those of a document go and come with it."""
    page = F.explode("pages").alias("page")
    return rows.select(F.col("id").alias("document_id"), page).select("document_id", "page.page_number", "page.text", F.length("page.text").alias("char_count"), "page.ocr_used", "page.ocr_confidence")


def _benchmark_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the benchmark table's texts, a file each."""
    folder = f"{shared_folder(spark, 'ingest-')}/ingest-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(f"{folder}/in")
    return folder


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("status", "department", t.word_count(F.col("extracted_text")).cast("long").alias("words"), F.sha2("extracted_text", 256).alias("digest"))


def demo(spark: SparkSession, sf_dir: str, stream: bool) -> DataFrame:
    """The benchmark table's texts, a file each, ingested and read back."""
    folder = _benchmark_files(spark, sf_dir)
    if stream:
        ingest_stream(spark, f"{folder}/in", f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    else:
        ingest(spark, f"{folder}/in", f"{folder}/store")
    return _shown(read_store(spark, f"{folder}/store"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table's texts ingested, all again by another uploader, one in three deleted, and one in six of all ingested once more."""
    folder = _benchmark_files(spark, sf_dir)
    files, store = f.read_files(spark, f"{folder}/in"), f"{folder}/store"
    item = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long")
    held = Store(spark, store)
    for day, name, some in ((1, "first", files), (2, "again", files), (4, "back", files.where(item % 6 == 0))):
        held.add(f"{day}", documents(some, uploaded_by=name, as_of=datetime(2024, 1, day)))
        if day == 2:
            delete(spark, store, files.where(item % 3 == 0).select(_id().alias("id")))
    rows = read_store(spark, store)
    return rows.select(item.alias("item_id"), "uploaded_by", "status", F.sha2("extracted_text", 256).alias("digest"), F.size("pages").cast("long").alias("pages"))


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table's texts as a reader sees them when all are accepted and half are read."""
    folder = _benchmark_files(spark, sf_dir)
    files, store = f.read_files(spark, f"{folder}/in"), f"{folder}/store"
    item = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long")
    day = datetime(2024, 1, 1)
    held = Store(spark, store)
    held.add("a", waiting(files, as_of=day))
    held.add("b", documents(files.where(item % 2 == 0), as_of=day))
    rows = read_store(spark, store)
    return rows.select(item.alias("item_id"), "status", "status_detail", F.greatest(F.coalesce(F.size("pages"), F.lit(0)), F.lit(0)).cast("long").alias("pages"), F.col("size_bytes").cast("long").alias("size_bytes"), "checksum", (F.col("search_blob") == F.lower("filename")).alias("name_only"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store gives back of the benchmark table's texts that it was given as files."""
    folder = _benchmark_files(spark, sf_dir)
    landed = land(f.read_files(spark, f"{folder}/in"), f"{folder}/store", "a")
    return landed.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("checksum"))
