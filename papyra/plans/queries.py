"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.functions import vocabulary as v
from papyra.operators import display, facets, rules, search
from papyra.operators.search import SearchParams, SearchSpec
from papyra.plans import store_queries
from papyra.plans.workers import checkpointed, small_batches
from papyra.sources import files
from papyra.sources import library as lib
from papyra.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
P = SearchParams.of


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def found(params: SearchParams, *columns: str, spec: SearchSpec = lib.LIBRARY, table: str | None = None) -> Query:
    """A search, with each row's place on the page."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet") if table else lib.library(spark, sf_dir)
        return search.search(df, spec, params).select(*(columns or (spec.id, "score")))

    return run


def filtered(**params) -> Query:
    """All ids that a filter leaves."""
    return lambda spark, sf_dir: search.filtered(lib.library(spark, sf_dir), lib.LIBRARY, P(as_of=lib.AS_OF, **params)).select("id")


def per_document(columns: dict[str, Callable[[], Column]]) -> Query:
    return lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", *[c().alias(n) for n, c in columns.items()])


def per_entry(columns: dict[str, Callable[[], Column]]) -> Query:
    return lambda spark, sf_dir: lib.library(spark, sf_dir).select("id", *[c().alias(n) for n, c in columns.items()])


def ruled(steps: tuple[Callable[[DataFrame], DataFrame], ...], *columns: Callable[[], Column]) -> Query:
    """Fields of the rule engine, by the steps that they need."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = rules.with_body(lib.spread(lib.library(spark, sf_dir).select("id", "filename", "extracted_text")))
        for step in steps:
            df = step(df)
        return df.select("id", *[c() for c in columns])

    return run


def counted(spec: SearchSpec, table: str | None = None, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet") if table else lib.library(spark, sf_dir)
        return facets.facets(df, spec, P(as_of=lib.AS_OF, **params))

    return run


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lib.library(spark, sf_dir)
    kept = [F.count_if(c).alias(p) if (c := search.date_condition(lib.LIBRARY, P(date_range=p, as_of=lib.AS_OF))) is not None else F.count("*").alias(f"{p}_time") for p in ("any", "today", "week", "recent", "older")]
    return df.agg(*kept)


HIGHLIGHTED = ["The", "he", "inspection", "a", "100%"]


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in whole texts, and the snippet with its hits in brackets."""
    hits = F.filter(display.highlighted(F.col("extracted_text"), HIGHLIGHTED), lambda p: p["hit"])
    shown = display.highlighted(search.snippet(F.col("extracted_text"), ["inspection", "the"]), HIGHLIGHTED)
    marked = F.array_join(F.transform(shown, lambda p: F.when(p["hit"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "")
    return lib.library(spark, sf_dir).select("id", F.size(hits).cast("long").alias("hits"), marked.alias("snippet")).where("hits > 0")


REPLY = """concat('{"title":"  Review of ', filename, ' ","department":"', department, '","priority":"p', CAST(id % 4 AS INT), '","document_type":"', lower(document_type), '","keywords":["  Alpha","BETA "],"risks":["", " late "],"actions":[{"action":" check ","owner":" x ","priority":"urgent"},{"action":" "}],"confidence":"', CASE WHEN id % 5 = 0 THEN 'high' WHEN id % 7 = 0 THEN '-0.25' ELSE concat(CAST(id % 3 AS INT), '.5') END, '"}')"""


def llm_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = rules.from_reply(F.col("reply"))
    rows = lib.library(spark, sf_dir).selectExpr("id", f"{REPLY} AS reply")
    plain = ("title", "department", "priority", "document_type", "confidence")
    return rows.select("id", *[fields[c].alias(c) for c in plain], F.array_join(fields["keywords"], "|").alias("keywords"), F.array_join(fields["risks"], "|").alias("risks"), F.size(fields["actions"]).cast("long").alias("n_actions"))


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, "not json").when(F.col("doc_id") % 4 == 2, '{"a": 1}').otherwise(F.concat(F.lit('["'), F.col("source"), F.lit('","'), F.col("lang"), F.lit('"]')))
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.coalesce(F.from_json(raw, F.lit("array<string>")), F.array().cast("array<string>")), "|").alias("items"))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library with its departments, types and priorities by the rule engine, ready for search."""
    rows = lib.spread(lib.library(spark, sf_dir).drop("search_blob"))
    rows = rules.analysed(rows).withColumns({
        "file_ext": t.file_extension(F.col("filename")), "size_bytes": F.octet_length("extracted_text").cast("long"), "word_count": t.word_count(F.col("extracted_text")).cast("long"),
        "language": t.language(F.col("extracted_text")), "processed_at": F.col("uploaded_at"), "status_detail": F.lit("Analysed with rule engine"), "analysis_engine": F.lit("rule-based"),
    })
    return rules.searchable(rows)


def search_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis and search from texts to a page of results: rows are analysed once, written, and searched like a store."""
    rows = checkpointed(analysed(spark, sf_dir))
    found = search.search(rows, lib.ANALYSED, P("inspection safety", {"priority": "High,Medium"}, page_size=100))
    return found.withColumns({"keywords": t.json_list(F.col("keywords")), "total": search.total(rows, lib.ANALYSED, P("inspection safety", {"priority": "High,Medium"})).scalar()})


def rule_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir).select("id", F.length("search_blob").cast("long").alias("n"), F.sha2("search_blob", 256).alias("digest"), "action_count", "deadline_count")


def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its id: all fields and the beginning of its text, which is whole elsewhere."""
    row = lib.library(spark, sf_dir).where("id = 77")
    return row.withColumn("text_preview", F.left("extracted_text", F.lit(4000))).drop("extracted_text", "search_blob")


#: Names of documents that nothing could be read of.
UNREAD = "concat(CASE id % 4 WHEN 0 THEN 'Tender document' WHEN 1 THEN 'audit_report' WHEN 2 THEN 'Tax-Invoice' ELSE 'note' END, '_', filename)"


def rule_empty_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without text, which are judged by their names alone."""
    rows = lib.library(spark, sf_dir).selectExpr("id", f"{UNREAD} AS filename", "CASE WHEN id % 3 = 0 THEN ' ' WHEN id % 3 = 1 THEN '' END AS extracted_text")
    rows = rules.analysed(rows)
    lists = ("secondary_departments", "key_points", "keywords", "actions", "deadlines", "risks", "compliance_flags")
    found = sum((F.size(c) for c in lists), F.lit(0)).cast("long").alias("entries")
    return rows.select("id", "title", "document_type", "department", "priority", "summary", F.col("analysis_confidence").alias("confidence"), found)


FAILED = "CASE WHEN id % 6 = 2 THEN 'TimeoutError' END"


def llm_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's replies for some rows, unreadable ones, errors and none for others; without text nothing is asked."""
    rows = lib.library(spark, sf_dir).selectExpr("id", "filename", "document_type", "department", "CASE WHEN id % 11 = 0 THEN ' ' ELSE extracted_text END AS extracted_text")
    rows = rows.selectExpr("*", f"CASE id % 6 WHEN 0 THEN {REPLY} WHEN 1 THEN {REPLY} WHEN 3 THEN 'no json' END AS reply", f"{FAILED} AS failure")
    return rules.with_fallback(rows, "reply", "failure").select("id", "department", "priority", "title", "analysis_engine", "analysis_error")


#: Invented files, from the documents: what follows from doc_id is their kind; page 2 and 3 of a PDF are scans, the third with nothing to recognise.
KINDS = ("txt", "docx", "pdf", "png", "exe", "csv", "log", "pdf")


def _file(kind: str, text: str) -> bytes:
    """Content of an invented file; a PDF here is its pages with form feeds between, the first of which may hold some itself, an image its text, whole."""
    if kind == "docx":
        return files.docx_of(text.split("\n"), [["a", " ", files.xml_text(text[:20]).strip() or "b"]])
    return "\f".join((text, "p2", "page three")).encode() if kind == "pdf" else text.encode()


def _recognised(text: str) -> tuple[str, float | None]:
    """A recogniser that is the surer the longer a word is, and not at all of single characters."""
    return files.ocr_text([(w, -1.0 if len(w) == 1 else min(100.0, 10.0 * len(w))) for w in text.split(" ")])


def _invented_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)

    def run(batches):
        for batch in batches:
            made = [_file(KINDS[i % 8], x or "") if i % 50 != 9 else b"" for i, x in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            paths = [f"/in/{i}/Note of {i}.{KINDS[i % 8].upper() if i % 3 == 0 else KINDS[i % 8]}" for i in batch["doc_id"].to_pylist()]
            lengths = [files.MOST_BYTES + 1 if i % 50 == 8 else len(m) for i, m in zip(batch["doc_id"].to_pylist(), made, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(lengths, pa.int64()), pa.array(made, pa.binary())], names=["path", "length", "content"])

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "path string, length long, content binary")


def _scan(pages: list[str], number: int) -> tuple[str, float | None]:
    """Page 2 shows what page 1 says; recognition of page 3 fails where that has an odd length."""
    if number == 2 and len(pages[0]) % 2:
        raise OSError("no engine")
    return _recognised(pages[0]) if number == 1 else ("x", 50.0)


DECODERS = {
    "PDF": lambda content: files.with_ocr(p := content.decode().rsplit("\f", 2), lambda i: _scan(p, i)),
    "IMAGE": lambda content: [((seen := _recognised(content.decode()))[0], True, seen[1])],
}


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.extract(_invented_files(spark, sf_dir), DECODERS)
    return rows.select("filename", "file_type", "file_ext", "page_count", "ocr_used", "ocr_quality", "extraction_method", F.sha2("extracted_text", 256).alias("digest"), F.col("word_count").cast("long").alias("words"), "warnings", "reason")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.extract(_invented_files(spark, sf_dir), DECODERS).withColumn("id", F.regexp_extract("path", "^/in/([0-9]+)/", 1).cast("long"))
    return ingest.pages(rows).select("document_id", "page_number", F.sha2("text", 256).alias("digest"), F.col("char_count").cast("long").alias("char_count"), "ocr_used", "ocr_confidence")


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


CASES = "CASE doc_id % 8 WHEN 0 THEN 'civil/track' WHEN 1 THEN ' SAFETY ' WHEN 2 THEN 'stores' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'p1' WHEN 6 THEN 'informational' ELSE 'board minutes' END"
NOW = datetime(2024, 3, 30, 12)


def ingested(stream: bool) -> Query:
    return lambda spark, sf_dir: ingest.demo(spark, sf_dir, stream)


QUERIES: dict[str, Query] = {
    "search_relevance": found(P("the that", as_of=lib.AS_OF), "id", "filename", "score"),
    "search_phrase": found(P('"the inspection" of', as_of=lib.AS_OF)),
    "search_all_terms": lambda s, d: search.filtered(lib.library(s, d), lib.LIBRARY, P("track inspection tamping")).select("id"),
    "search_page2": found(P("the that", page=2, as_of=lib.AS_OF)),
    "search_total": lambda s, d: search.total(lib.library(s, d), lib.LIBRARY, P("the that", {"department": ["Safety", "Finance", "IT"]})),
    "search_snippet": found(P("inspection of", as_of=lib.AS_OF, page_size=50), "id", "snippet"),
    "search_escape_chars": lambda s, d: search.filtered(lib.library(s, d), lib.LIBRARY, P("src1_en 100% a_b")).select("id").unionByName(search.filtered(lib.library(s, d), lib.LIBRARY, P("src1_en")).select("id")),
    "search_highlight": highlights,
    "search_blob": per_entry({"n": lambda: F.length("search_blob").cast("long"), "digest": lambda: F.sha2("search_blob", 256)}),
    "search_part_catalog": found(P("st", page_size=50), spec=lib.PARTS, table="part"),
    "search_pages_html": found(P("example the", page_size=50), spec=lib.PAGES, table="pages"),
    "search_events": found(P("k", {"event_type": "click,view"}, sort="newest", page_size=50), spec=lib.EVENTS, table="events"),
    "search_conversations": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").where(search.matches(SearchSpec("conv_id", {"role": 30, "text": 10}, ("text", "role")), ["user", "the"])).select("conv_id", "turn", search.score(SearchSpec("conv_id", {"role": 30, "text": 10}, ()), ["user", "the"]).alias("score")),
    "filter_department": filtered(filters={"department": "Safety, Finance"}),
    "filter_priority": filtered(filters={"priority": ["High"]}),
    "filter_file_type": filtered(filters={"file_type": "pdf,image"}),
    "filter_status_alias": filtered(filters={"status": ["AI Analysis Complete", "OCR processing", "nonsense"]}),
    "filter_status_unknown": filtered(filters={"status": ["nonsense"]}),
    "filter_doc_type": filtered(filters={"document_type": ["Invoice", "Tender / Contract"]}),
    "filter_date_presets": presets,
    "filter_date_bounds": filtered(date_range="recent", date_from=datetime(2024, 3, 10), date_to=datetime(2024, 3, 20, 6)),
    "filter_combined": filtered(q="inspection", filters={"department": "Safety,IT,HR", "priority": "High,Low", "status": "complete"}, date_range="recent"),
    "filter_low_ocr": lambda s, d: lib.library(s, d).where(facets.low_quality_ocr(F.col("ocr_used"), F.col("ocr_quality"))).select("id"),
    "sort_newest": found(P(sort="newest"), "id", "uploaded_at"),
    "sort_oldest": found(P(sort="oldest", page=3), "id", "uploaded_at"),
    "sort_name": found(P(sort="name"), "id", "filename"),
    "sort_priority": found(P(sort="priority", page_size=100), "id", "priority"),
    "sort_orders": found(P(sort="priority", page_size=50), "o_orderkey", "o_orderpriority", spec=lib.ORDERS, table="orders"),
    "facets_self_excluding": counted(lib.LIBRARY, filters={"department": "Safety,Finance", "priority": "High", "status": "complete"}),
    "facets_with_query": counted(lib.LIBRARY, q="inspection the", filters={"file_type": "pdf"}, date_range="recent"),
    "facets_orders": counted(lib.ORDERS, "orders", filters={"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "5-LOW"]}),
    "facets_events": counted(lib.EVENTS, "events", filters={"event_type": "click"}),
    "facets_displayed": lambda s, d: facets.displayed(counted(lib.LIBRARY, filters={"department": "Safety"})(s, d), {"department": ["Safety"]}, {"department": list(v.DEPARTMENTS)}).select("facet", "value", "count", "selected", "ord"),
    "stats_library": lambda s, d: facets.stats(lib.library(s, d)).drop("actions"),
    "stats_actions": lambda s, d: rules.with_sentences(rules.with_body(lib.library(s, d))).where("status = 'analysis_complete'").agg(F.coalesce(F.sum(F.least(F.size(F.filter("_sentences", lambda x: t.has_phrase(x["tags"], v.ACTION_SIGNALS))), F.lit(8))), F.lit(0)).cast("long").alias("actions"), F.count("*").alias("complete")),
    "text_clean": per_document({"digest": lambda: F.sha2(t.clean(F.concat(F.lit(" \t"), F.replace("text", F.lit("."), F.lit(".\n\n\n \t ")))), 256)}),
    "text_reflow": per_document({"body": lambda: F.sha2(t.reflow(t.trimmed(F.regexp_replace("text", r"([^\n]{50}[^ \n]*) ", "$1\n"))), 256)}),
    "text_sentences": per_document({"n": lambda: F.size(t.sentences(F.col("text"))).cast("long"), "digest": lambda: F.sha2(_joined(t.sentences(F.col("text"))), 256)}),
    "text_tokens": per_document({"n": lambda: F.size(t.tokens(F.col("text"))).cast("long"), "digest": lambda: F.sha2(_joined(t.tokens(F.col("text"))), 256)}),
    "text_upper_ratio": per_document({"ratio": lambda: F.round(t.upper_ratio(F.col("text")), 9)}),
    "text_trim": per_document({"short": lambda: t.trim_to(F.col("text"), 220)}),
    "text_word_count": per_document({"words": lambda: t.word_count(F.col("text")).cast("long"), "chars": lambda: F.length("text").cast("long")}),
    "text_language": per_entry({"language": lambda: t.language(F.col("extracted_text")), "own": lambda: t.language(F.left("extracted_text", F.lit(60)))}),
    "text_title_from_filename": per_entry({"title": lambda: t.title_from_filename(F.concat(F.lit("final__report2b-"), F.col("filename")))}),
    "text_safe_filename": per_entry({"safe": lambda: t.safe_filename(F.concat(F.lit("../a/b (1) é&"), F.col("filename")))}),
    "text_file_type": per_entry({"kind": lambda: t.file_type(F.col("filename")), "ext": lambda: t.file_extension(F.col("filename"))}),
    "text_chunk": lambda s, d: documents(s, d).select("doc_id", *[c.alias(n) for n, c in t.chunk(F.col("text"), 100, 400).items()]).withColumn("total_chars", F.col("total_chars").cast("long")),
    "text_preview": per_document({"preview": lambda: F.sha2(F.left("text", F.lit(4000)), 256)}),
    "text_sha256": per_document({"checksum": lambda: F.sha2("text", 256)}),
    "text_phrase_count": per_entry({n: (lambda w=w: t.phrase_count(t.tagged(F.col("extracted_text")), w).cast("long")) for n, w in (("the", "the"), ("of_the", "of the"), ("subject", "subject:"), ("safety", "safety"))}),
    "rule_department": ruled((rules.with_department,), lambda: F.col("department")),
    "rule_secondary": ruled((rules.with_department,), lambda: _joined("secondary_departments").alias("secondary")),
    "rule_doc_type": ruled((), lambda: rules.document_type(F.col("_hits")).alias("document_type")),
    "rule_priority": ruled((rules.with_department, rules.with_priority), lambda: F.col("priority")),
    "rule_keywords": ruled((rules.with_terms,), lambda: _joined(F.slice("_terms", 1, rules.KEYWORDS)).alias("keywords")),
    "rule_summary": ruled((rules.with_terms, rules.with_sentences, rules.with_summary), lambda: F.col("summary"), lambda: _joined("key_points").alias("key_points")),
    "rule_actions": ruled((rules.with_department, rules.with_priority, rules.with_sentences), lambda: _joined(F.transform(rules.actions(), lambda a: F.concat_ws("~", a["action"], a["owner"], a["due_date"], a["priority"]))).alias("actions")),
    "rule_deadlines": ruled((rules.with_sentences,), lambda: _joined(F.transform(rules.deadlines(), lambda a: F.concat_ws("~", a["date"], a["description"]))).alias("deadlines")),
    "rule_risks": ruled((rules.with_sentences,), lambda: _joined(rules.risks()).alias("risks")),
    "rule_flags": ruled((), lambda: _joined(rules.flags(F.col("_hits"))).alias("flags")),
    "rule_title": ruled((rules.with_title,), lambda: F.col("title")),
    "rule_confidence": ruled((rules.with_department,), lambda: rules.confidence(F.col("_body"), F.col("_top")).alias("confidence")),
    "normalise_department": lambda s, d: documents(s, d).select("doc_id", v.normalise_department(F.expr(CASES)).alias("department")),
    "normalise_priority": lambda s, d: documents(s, d).select("doc_id", v.normalise_priority(F.expr(CASES)).alias("priority")),
    "normalise_doc_type": lambda s, d: documents(s, d).select("doc_id", v.normalise_document_type(F.expr(CASES)).alias("document_type")),
    "status_labels": per_entry({"label": lambda: v.status_label(F.col("status"))}),
    "llm_postprocess": llm_postprocess,
    "json_decode_lists": json_lists,
    "format_bytes": per_document({"size": lambda: display.format_bytes(F.col("n_chars") * F.col("n_chars"))}),
    "relative_time": per_entry({"when": lambda: display.relative_time(F.col("uploaded_at"), NOW)}),
    "search_analysed": search_analysed,
    "rule_blob": rule_blob,
    "llm_fallback": llm_fallback,
    "extract_files": extracted,
    "page_table": page_table,
    "filter_in_progress": lambda s, d: lib.library(s, d).where(facets.in_progress(F.col("status"))).select("id"),
    "json_encode_lists": per_document({"items": lambda: t.json_list(F.array("source", F.substring("text", 1, 30), F.lit('é "q" \\')))}),
    "store_lifecycle": ingest.lifecycle,
    "store_stages": ingest.stages,
    "store_downloads": ingest.downloads,
    "document_detail": document_detail,
    "rule_empty_body": rule_empty_body,
    "ingest_batch_text": ingested(False),
    "ingest_stream_text": ingested(True),
    **store_queries.QUERIES,
}
