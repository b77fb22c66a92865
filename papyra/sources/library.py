"""The document library over the documents table: facts that are functions of doc_id, and a memo line before each text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import vocabulary as v
from papyra.operators.search import SearchSpec

AS_OF = datetime(2024, 3, 30, 12)
#: Bytes of a table that is a single row group's work, as Parquet writes them.
SMALL_BYTES = 128 << 20
MEMOS = (
    "Subject: Mandatory inspection of platform doors. All controllers shall complete the inspection by 30/09/2025. Failure to comply may attract a penalty.",
    "TAX INVOICE. Payment of the vendor invoice is due within 30 days of receipt and finance must confirm the accounts entry.",
    "Tender document for spare parts. Bidders must submit a quotation to procurement before 15 October 2025.",
    "Refresher training for station staff is scheduled and employees are requested to attend. Payroll will be updated.",
    "Incident report: an axle counter failure caused a delay. Immediate action required, escalate to safety within 24 hours.",
    "The legal opinion advises that the agreement clause permits arbitration and there is a litigation risk. Counsel shall reply by March 5, 2026.",
    "Track geometry inspection found two alignment defects and tamping is required to be completed by 5-10-2025.",
    "The database server and network application need a software review and IT is responsible for the dashboard. Vendor selection follows the procurement tender.",
    "Traction power shutdown at the substation and breaker servicing must finish on time. Emergency lighting on ups supply.",
    "സുരക്ഷാ പരിശോധന നടത്തണം. Safety circular: near miss and hazard reports are mandatory under the audit directive.",
    "For information only. Nothing further is needed at this moment in time.",
)
_STATUSES = "failed|processing|ocr_processing|ai_analysis|queued|analysis_complete|analysis_complete|analysis_complete|analysis_complete|analysis_complete|analysis_complete"


def _pick(values: str, by: int) -> str:
    return f"split_part('{values}','|',CAST(doc_id % {by} + 1 AS INT))"


#: Column and its SQL, which Spark and DuckDB read alike.
COLUMNS = {
    "id": "doc_id + 1",
    "filename": f"concat(source, '_', lang, '-', doc_id, '.', {_pick('pdf|docx|txt|png', 4)})",
    "file_type": _pick("PDF|DOCX|TXT|IMAGE", 4),
    "department": _pick("|".join([*v.DEPARTMENTS, v.UNASSIGNED]), 13),
    "priority": _pick("High|Medium|Low|Medium|Low", 5),
    "status": _pick(_STATUSES, 11),
    "document_type": _pick("|".join(["", *v.DOCUMENT_TYPES]), 17),
    "page_count": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(ceil(n_chars / 1800.0) AS INT) END",
    "ocr_used": "doc_id % 4 = 3",
    "ocr_quality": "CASE WHEN doc_id % 4 = 3 THEN CAST(40 + doc_id % 60 AS DOUBLE) END",
    "extracted_text": f"CASE WHEN doc_id % 12 = 11 THEN text ELSE concat({_pick('|'.join(MEMOS), 12)}, chr(10), text) END",
}
_UPLOADED = "timestampadd(MINUTE, CAST(doc_id % 1440 AS INT), timestampadd(DAY, CAST(doc_id % 90 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00'))"
_BLOB = "lower(concat_ws(concat(' ', chr(10)), filename, nullif(document_type, ''), department, priority, extracted_text))"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.selectExpr(*[f"{sql} AS {name}" for name, sql in COLUMNS.items()], f"{_UPLOADED} AS uploaded_at")
    return rows.withColumn("search_blob", F.expr(_BLOB))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of few and small files dealt to all cores, as one row group keeps but one of them busy; of any other table as they are, without a shuffle. Results are alike."""
    spark, paths = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not paths or len(paths) >= cores:
        return df
    size = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0]
    return df.repartition(cores) if size <= SMALL_BYTES else df


def duckdb_library() -> str:
    """The same rows, as a query for DuckDB."""
    columns = ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())
    uploaded = "TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 90) + INTERVAL 1 MINUTE * (doc_id % 1440)"
    return f"SELECT *, {_BLOB} AS search_blob FROM (SELECT {columns}, {uploaded} AS uploaded_at FROM documents)"


LIBRARY = SearchSpec(
    id="id",
    weights={"filename": 50, "document_type": 40, "department": 30, "extracted_text": 10},
    blob=("search_blob",),
    filters={"department": "department", "priority": "priority", "file_type": "file_type", "status": "status", "document_type": "document_type"},
    timestamp="uploaded_at",
    name="filename",
    text="extracted_text",
    rank="priority",
    labels={"status": v.STATUS_LABELS},
    projection=("filename", "file_type", "department", "priority", "document_type", "page_count", "uploaded_at"),
)
#: A library of analysed documents, whose title, keywords and summary weigh too, with all that a list of results shows.
ANALYSED = SearchSpec(
    id="id",
    weights={"filename": 50, "title": 34, "document_type": 40, "department": 30, "keywords_text": 26, "summary": 20, "extracted_text": 10},
    blob=("search_blob",),
    filters=LIBRARY.filters,
    timestamp="uploaded_at",
    name="filename",
    text="extracted_text",
    rank="priority",
    labels=LIBRARY.labels,
    projection=("filename", "title", "file_type", "file_ext", "size_bytes", "uploaded_at", "processed_at", "status", "status_detail", "page_count", "word_count", "language", "ocr_used", "ocr_quality", "document_type", "department", "priority", "summary", "keywords", "action_count", "deadline_count", "analysis_engine"),
)
ORDERS = SearchSpec("o_orderkey", {"o_orderpriority": 30, "o_orderstatus": 10}, ("o_orderpriority", "o_orderstatus"), {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}, "o_orderdate", rank="o_orderpriority", ranks=(("1-URGENT", "2-HIGH"), ("3-MEDIUM",)), projection=("o_orderpriority", "o_orderdate"))
PARTS = SearchSpec("p_partkey", {"p_name": 50, "p_type": 40, "p_brand": 30}, ("p_name", "p_type", "p_brand"), {"p_brand": "p_brand", "p_type": "p_type"}, name="p_name", projection=("p_name", "p_brand"))
EVENTS = SearchSpec("event_id", {"event_type": 50, "props": 10}, ("event_type", "props"), {"event_type": "event_type"}, "ts", projection=("event_type",))
PAGES = SearchSpec("page_id", {"url": 50, "html": 10}, ("url", "html"), name="url", text="html", projection=("url",))
