"""Registered queries over stores and indexes made of the driver's tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import indexes, rules, search
from papyra.operators.search import SearchParams
from papyra.plans.workers import checkpointed, shared_folder
from papyra.sources import library as lib
from papyra.streaming import ingest, live, progress
from papyra.streaming.store import Store

P = SearchParams.of
#: Searches by trigrams: words, a phrase, another script, no letters, short terms, none that is found.
SEARCHES = ("track inspection tamping", '"the inspection" of', "സുരക്ഷാ", "src1_en 100% a_b", "of a", "src1_en", "zzzzqq the")
DAY = datetime(2024, 1, 1)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library with its ids as numbers of rows, in one batch."""
    return lib.library(spark, sf_dir).withColumns({"ord": F.col("id"), "batch": F.lit("b")})


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several searches find by postings, and by texts where postings leave some."""
    rows = numbered(spark, sf_dir)
    index = checkpointed(indexes.postings(rows).withColumn("batch", F.lit("b")))
    every = None
    for number, query in enumerate(SEARCHES):
        found = indexes.candidates(index, search.parse_terms(query), "batch")
        some = rows if found is None else rows.join(F.broadcast(found.withColumnRenamed("place", "ord")), ["batch", "ord"], "left_semi")
        one = search.filtered(some, lib.LIBRARY, P(query)).select(F.lit(number).alias("query"), "id")
        every = one if every is None else every.unionByName(one)
    return every


def facets_bitmap(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    asked = P(as_of=lib.AS_OF, **params)
    rows = numbered(spark, sf_dir)
    index = checkpointed(indexes.bitmaps(rows).withColumn("batch", F.lit("b")))
    hits = None
    if asked.q or any(search.date_bounds(asked)):
        hits = search.filtered(rows, lib.LIBRARY, P(asked.q, date_range=asked.date_range, as_of=lib.AS_OF)).select("batch", "ord")
    return indexes.facets(index, lib.LIBRARY, asked, hits=hits)


def stats_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the library without every seventh document, which is gone."""
    rows = numbered(spark, sf_dir)
    index = checkpointed(indexes.bitmaps(rows).withColumn("batch", F.lit("b")))
    return indexes.stats(index, gone=rows.where("id % 7 = 3").select("batch", "ord")).drop("actions")


def ranked(params: SearchParams, *columns: str):
    return lambda spark, sf_dir: search.ranked(lib.library(spark, sf_dir), lib.LIBRARY, params).select(*columns)


def seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the library by date, got by the last row of each page before it."""
    df, params = lib.library(spark, sf_dir), P(sort="newest", page_size=15)
    cursor = None
    for _ in range(2):
        cursor = search.cursor(search.after(df, lib.LIBRARY, params, cursor, secret="of the invented tables"), lib.LIBRARY, params, secret="of the invented tables")
    return search.after(df, lib.LIBRARY, params, cursor, secret="of the invented tables").select("id", "uploaded_at")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark, 'stores-')}/store-{uuid.uuid4().hex}"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table's texts as files."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return rows.select(F.concat(F.lit("/in/"), "item_id", F.lit("/note.txt")).alias("path"), F.octet_length("content").cast("long").alias("length"), "content")


def _item() -> Column:
    return F.regexp_extract("path", "/in/([0-9]+)/", 1).cast("long")


def two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of the benchmark table's texts, by odd and even numbers, into one store."""
    folder = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    for part in (0, 1):
        rows.where(F.col("item_id") % 2 == part).repartition("item_id").write.partitionBy("item_id").text(f"{folder}/in{part}")
        ingest.ingest_stream(spark, f"{folder}/in{part}", f"{folder}/store", f"{folder}/check{part}", uploaded_by=f"stream {part}").awaitTermination()
    found = ingest.read_store(spark, f"{folder}/store")
    return found.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "uploaded_by", "status", F.sha2("extracted_text", 256).alias("digest"))


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table's texts, one in three deleted, one in six uploaded again after that."""
    store = Store(spark, _folder(spark))
    rows = _files(spark, sf_dir)
    store.add("first", ingest.documents(rows, as_of=DAY, uploaded_by="first"))
    ingest.delete(spark, store.path, rows.where(_item() % 3 == 0).select(ingest._id().alias("id")))
    store.add("again", ingest.documents(rows.where(_item() % 6 == 0), as_of=DAY, uploaded_by="again"))
    return store.rows().select(_item().alias("item_id"), "uploaded_by", F.sha2("extracted_text", 256).alias("digest"))


def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all files of a store hold of the benchmark table's texts after one in three is deleted and purged: rows of documents and of files."""
    store = Store(spark, _folder(spark))
    rows = ingest.land(_files(spark, sf_dir), store.path, "a")
    store.add("a-3", ingest.documents(rows, as_of=DAY))
    store.delete(rows.where(_item() % 3 == 0).select("id"))
    store.purge()
    kept = spark.read.parquet(f"{store.path}/documents").select(_item().alias("item_id"), F.lit("document").alias("kind"))
    return kept.unionByName(spark.read.parquet(f"{store.path}/originals").select(_item().alias("item_id"), F.lit("file").alias("kind")))


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of files that cannot be read: the benchmark table's texts under names of DOCX files and of unsupported ones."""
    rows = _files(spark, sf_dir).withColumn("path", F.concat(F.lit("/in/"), _item(), F.when(_item() % 2 == 0, "/Safety circular.docx").otherwise("/Tender.exe")))
    found = ingest.documents(rows, as_of=DAY)
    lists = sum((F.size(c) for c in ("keywords", "key_points", "actions", "deadlines", "risks", "compliance_flags", "secondary_departments")), F.lit(0)).cast("long")
    return found.select(_item().alias("item_id"), "status", "title", "document_type", "department", "priority", "summary", "search_blob", "language", F.col("word_count").cast("long").alias("word_count"), F.col("analysis_confidence").isNull().alias("no_confidence"), lists.alias("entries"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents from their chunks in a store."""
    store = Store(spark, _folder(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("extracted_text"), F.lit("").alias("search_blob"))
    store.add("a", docs)
    rows = store.read("chunks", ["a"], "id long, chunk int, text string, batch string")
    parts = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
    return parts.select("id", F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), ""), 256).alias("digest"), F.size("parts").cast("long").alias("chunks"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by status at each commit of an ingest of the benchmark table's texts, of which those with numbers divisible by five cannot be read."""
    store = Store(spark, _folder(spark))
    rows = _files(spark, sf_dir).withColumn("path", F.when(_item() % 5 == 0, F.concat(F.lit("/in/"), _item(), F.lit("/note.docx"))).otherwise(F.col("path")))
    ingest._write(ingest.land(rows, store.path, "t1"), store, "t1")
    return progress.history(store).select("version", "stage", "status", "documents")


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of the library as they follow its store: all documents come, every seventh goes, every fifth comes anew and is urgent, a compaction changes nothing."""
    store = Store(spark, _folder(spark))
    target, every = f"{store.path}-figures", None
    docs = lib.library(spark, sf_dir).select("id", "filename", "status", "department", "priority", "page_count", F.lit(None).cast("string").alias("extracted_text"), F.col("filename").alias("search_blob"))
    steps = (
        lambda: store.add("a", docs),
        lambda: store.delete(docs.where("id % 7 = 3")),
        lambda: store.add("b", docs.where("id % 5 = 0").withColumns({"priority": F.lit("High"), "status": F.lit("analysis_complete"), "page_count": F.lit(2)})),
        lambda: store.compact(),
    )
    for number, step in enumerate(steps):
        step()
        live.follow(store, target, f"{target}-checkpoint").awaitTermination()
        one = checkpointed(live.figures(store, target).drop("version", "actions").withColumn("step", F.lit(number)))
        every = one if every is None else every.unionByName(one)
    return every


#: Replies of all shapes, by id.
SHAPES = """CASE id % 8 WHEN 0 THEN '{"actions":"x"}' WHEN 1 THEN '{"actions":[1]}' WHEN 2 THEN '{"department":5}' WHEN 3 THEN '[]' WHEN 4 THEN '{"keywords":7}' WHEN 5 THEN concat('{"department":"', department, '","actions":[{"action":"go"}]}') WHEN 6 THEN '{"actions":null,"priority":"p1","confidence":"nan"}' END"""


def wrong_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the wrong shape are left to the rules."""
    rows = lib.spread(lib.library(spark, sf_dir)).selectExpr("id", "filename", "department", "extracted_text").selectExpr("*", f"{SHAPES} AS reply", "CAST(NULL AS STRING) AS failure")
    got = rules.with_fallback(rows, "reply", "failure")
    return got.select("id", "department", "priority", "analysis_engine", "analysis_error", F.when(F.col("analysis_engine") == "model", F.size("actions")).cast("long").alias("asked"))


QUERIES = {
    "search_indexed": search_indexed,
    "search_ranked": ranked(P("the that", page=2, as_of=lib.AS_OF), "id", "score"),
    "search_ranked_snippet": ranked(P("inspection of", as_of=lib.AS_OF, page_size=50), "id", "snippet"),
    "search_seek": seek,
    "facets_bitmap": lambda s, d: facets_bitmap(s, d, filters={"department": "Safety,Finance", "priority": "High", "status": "complete"}),
    "facets_bitmap_query": lambda s, d: facets_bitmap(s, d, q="inspection the", filters={"file_type": "pdf"}, date_range="recent"),
    "stats_bitmap": stats_bitmap,
    "store_two_streams": two_streams,
    "store_delete": deleted,
    "store_purge": purged,
    "store_failed": failed,
    "store_chunks": chunks,
    "store_progress": staged,
    "store_live_figures": followed,
    "llm_wrong_shapes": wrong_shapes,
}
