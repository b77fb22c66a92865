"""Facade over a store of documents: search, facets, figures, single documents, ingest and deletion."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.functions import vocabulary as v
from papyra.operators import indexes, rules, search
from papyra.operators.search import Paging, SearchParams, SearchSpec
from papyra.sources import files
from papyra.sources.library import ANALYSED
from papyra.plans.workers import checkpointed
from papyra.streaming import ingest, progress
from papyra.streaming.store import CHUNK, MOST_STALE, Snapshot, Store


@dataclass(frozen=True)
class SearchPage:
    items: DataFrame
    paging: Paging
    applied: dict
    message: str


class Engine:
    def __init__(self, spark: SparkSession, store: str, spec: SearchSpec = ANALYSED):
        self.spark, self.store, self.spec = spark, store, spec
        self._store = Store(spark, store)

    def documents(self) -> DataFrame:
        return rules.searchable(ingest.read_store(self.spark, self.store))

    def _index(self, snapshot: Snapshot, table: str) -> DataFrame:
        schema = {"postings": "trigram long, n long, places array<long>", "bitmaps": "facet string, value string, bucket long, bits binary"}[table]
        return self._store.read(table, list(snapshot.batches), f"{schema}, batch string")

    def _matching(self, snapshot: Snapshot, q: str) -> DataFrame:
        """Documents of one version that may have the query's terms, as their trigrams say."""
        rows = self._store.rows(snapshot)
        terms = search.parse_terms(q)
        found = indexes.candidates(self._index(snapshot, "postings"), terms, "batch") if terms else None
        if found is None:
            return rules.searchable(rows)
        found = checkpointed(found)
        few = found.limit(MOST_STALE + 1).count()
        if few <= search.MOST_ROWS:
            # By number, so that row groups without one are skipped.
            rows = rows.where(F.col("ord").isin(*{r["place"] for r in found.select("place").collect()}))
        found = found.withColumnRenamed("place", "ord")
        return rules.searchable(rows.join(F.broadcast(found) if few <= MOST_STALE else found, ["batch", "ord"], "left_semi"))

    def search(self, params: SearchParams) -> SearchPage:
        snapshot = self._store.snapshot()
        df = self._matching(snapshot, params.q)
        total = search.total(df, self.spec, params).first()["total"]
        message = ""
        if not total:
            asked, narrowed = bool(params.q), bool(params.applied_filters())
            message = "No document has these words under these filters." if asked and narrowed else "No document has these words." if asked else "No document passes these filters." if narrowed else "The library is empty."
        return SearchPage(search.ranked(df, self.spec, params), Paging(total, params.page, params.page_size), params.applied_filters(), message)

    def facets(self, params: SearchParams) -> DataFrame:
        """From the bitmaps; only what keywords and dates leave is looked up among the documents."""
        snapshot, plain = self._store.snapshot(), replace(params, page=1)
        hits = None
        if params.q or any(search.date_bounds(params)):
            hits = search.filtered(self._matching(snapshot, params.q), self.spec, replace(plain, filters={})).select("batch", "ord")
        gone = self._store.gone(snapshot) if snapshot.n_gone else None
        return indexes.facets(self._index(snapshot, "bitmaps"), self.spec, plain, gone=gone, hits=hits)

    def stats(self) -> DataFrame:
        snapshot = self._store.snapshot()
        return indexes.stats(self._index(snapshot, "bitmaps"), gone=self._store.gone(snapshot) if snapshot.n_gone else None)

    def uploads(self) -> DataFrame:
        """How far each upload is."""
        return progress.uploads(self._store)

    def poll(self, keys: DataFrame | list[int]) -> DataFrame:
        """How far these documents are."""
        return progress.poll(self._store, keys)

    def filter_options(self) -> dict[str, list[str]]:
        return {"department": [*v.DEPARTMENTS, v.UNASSIGNED], "priority": [*v.PRIORITIES], "file_type": [*v.FILE_TYPES], "document_type": [*v.DOCUMENT_TYPES], "status": [*v.STATUS_LABELS.values()], "sort": [*search.SORTS]}

    def capabilities(self) -> dict:
        return {"status": "ok", "decoders": files.decoders_available(), "extensions": list(files.SUPPORTED), "most_bytes": files.MOST_BYTES}

    @staticmethod
    def _found(df: DataFrame, key: int) -> Row:
        row = df.first()
        if row is None:
            raise KeyError(f"no document {key}")
        return row

    def detail(self, key: int) -> Row:
        """All fields, with the first 4,000 characters of the text."""
        row = rules.searchable(self._store.row(key)).withColumn("text_preview", F.left("extracted_text", F.lit(4000)))
        return self._found(row.drop("extracted_text", "search_blob", "keywords_text", "batch", "ord"), key)

    def text(self, key: int, offset: int = 0, limit: int = 20_000) -> Row:
        """A part of a document's text, from the chunks that hold it."""
        t.chunk(F.lit(""), offset, limit)
        row = self._found(self._store.row(key, "batch", "char_count"), key)
        chunks = self._store.chunks(row["batch"], key, offset // CHUNK, (offset + limit - 1) // CHUNK).collect()
        start = offset - offset // CHUNK * CHUNK
        part = "".join(c["text"] for c in chunks)[start : start + limit]
        return Row(text=part, total_chars=row["char_count"], has_more=offset + limit < row["char_count"])

    def original(self, key: int) -> bytes:
        """The bytes of a document's file as they were landed."""
        row = self._found(self._store.row(key, "landed"), key)
        return bytes(self._found(self._store.read("originals", [row["landed"]]).where(F.col("id") == key).select("content"), key)["content"] or b"")

    def ingest(self, source: str, **options) -> str:
        return ingest.ingest(self.spark, source, self.store, **options)

    def reprocess(self, keys: DataFrame | list[int], **options) -> None:
        """Read the stored files of these documents again, in one batch; the new rows stand in for the old."""
        ingest.reprocess(self.spark, self.store, keys, **options)

    def delete(self, keys: DataFrame | list[int]) -> None:
        ingest.delete(self.spark, self.store, keys)

    def purge(self) -> None:
        """Remove the rows, texts and bytes of all that is deleted or superseded."""
        self._store.purge()
