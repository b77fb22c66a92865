"""A store of documents: tables in batches, a log that says which of them count, and what is gone of them.

Each batch is a folder of Parquet under documents, each file sorted by id, with the texts
once more in chunks, and the indexes of operators.indexes. Nothing of it is seen before an entry
of the log names it. Entries are numbered files that are written whole and never over one
another; who comes second reads the new state and tries again. So a reader, who
reads the log once, sees one version however many writers there are, and order is the log's,
not a clock's. Rows that a later batch stands in for, or that are deleted, are listed as
gone by the entry that removed them. compact() copies what is left of batches into a new one, purge() then removes
the folders that no longer count, and with them all that is gone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra.operators import indexes
from papyra.plans.workers import remove

#: Gone rows up to which they are broadcast to a reader, or new ids to a writer; beyond that rows are joined by a shuffle.
MOST_STALE = 500_000
#: Code points of a chunk of text.
CHUNK = 8192
#: Files are read by id: small row groups and pages, and a filter of the ids of each.
BY_ID = {"parquet.block.size": 16 << 20, "parquet.page.size": 64 << 10, "parquet.bloom.filter.enabled#id": "true", "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 100, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 100}
#: Parquet looks at the size of what it holds after each of these rows, as one may be a whole file.
LARGE_ROWS = {**BY_ID, "parquet.block.size.row.check.max": 8, "parquet.page.size.row.check.max": 8}
TABLES = ("documents", "chunks", "postings", "bitmaps")


@dataclass(frozen=True)
class Snapshot:
    """One version of a store: the schema of each batch that counts, in the log's order, the folders that list gone rows, and how many there are; all batches there ever were."""

    version: int = 0
    batches: dict[str, str] = field(default_factory=dict)
    gone: tuple[str, ...] = ()
    n_gone: int = 0
    ever: frozenset[str] = frozenset()

    def after(self, entry: dict) -> Snapshot:
        batches = {b: s for b, s in self.batches.items() if b not in entry["remove"]} | entry["add"]
        gone = tuple(entry["gone"]) if entry["base"] else (*self.gone, *entry["gone"])
        return Snapshot(entry["version"], batches, gone, entry["n_gone"] + (0 if entry["base"] else self.n_gone), self.ever | entry["add"].keys())

    @property
    def schema(self) -> StructType:
        """All columns that any batch has."""
        known = {f.name: f for text in dict.fromkeys(self.batches.values()) for f in StructType.fromJson(json.loads(text)).fields}
        return StructType(list(known.values()))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> bool:
        """A new file with this text, which appears whole; False if there is one already."""
        jvm, target, fs = self._hadoop(path)
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.mkdirs(target.getParent())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, plain)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def entries(self) -> list[dict]:
        """The log, in order."""
        try:
            lines = self.spark.read.schema("value string").text(f"{self.path}/log").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted((json.loads(r["value"]) for r in lines), key=lambda e: e["version"])

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The store as its log is now, or as it was at an earlier version whose folders are not purged."""
        found = Snapshot()
        for entry in self.entries():
            if version is None or entry["version"] <= version:
                found = found.after(entry)
        return found

    def commit(self, change: Callable[[Snapshot], dict | None]) -> int | None:
        """Append an entry to the log: change says what it adds, removes and lists as gone in a version, None if there is nothing to do. It is asked again if another writer was first. Gives the new version."""
        while True:
            seen = self.snapshot()
            entry = change(seen)
            if entry is None:
                return None
            entry = {"add": {}, "remove": [], "gone": [], "n_gone": 0, "base": False, **entry, "version": seen.version + 1}
            if self._put(f"{self.path}/log/{entry['version']:012d}.json", json.dumps(entry)):
                return entry["version"]

    def _folders(self, table: str, batches: Sequence[str]) -> list[str]:
        return [f"{self.path}/{table}/batch={b}" for b in batches]

    def read(self, table: str, batches: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
        """Rows of these batches, with the batch as a column."""
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(*self._folders(table, batches)).withColumn("batch", F.col("batch").cast("string"))

    def gone(self, snapshot: Snapshot) -> DataFrame:
        """id, batch and ord of rows that no longer count."""
        if not snapshot.gone:
            return self.spark.createDataFrame([], "id long, batch string, ord long")
        return self.spark.read.schema("id long, batch string, ord long").parquet(*[f"{self.path}/gone/{g}" for g in snapshot.gone])

    def live(self, rows: DataFrame, snapshot: Snapshot) -> DataFrame:
        """Of rows with batch and ord those that count."""
        if not snapshot.n_gone:
            return rows
        gone = self.gone(snapshot).select("batch", "ord")
        return rows.join(F.broadcast(gone) if snapshot.n_gone <= MOST_STALE else gone, ["batch", "ord"], "left_anti")

    def rows(self, snapshot: Snapshot | None = None, batches: Sequence[str] | None = None) -> DataFrame:
        """All documents that count, or those of some batches, with batch and ord; a reader takes the columns that it needs."""
        snapshot = snapshot or self.snapshot()
        if not snapshot.batches:
            raise FileNotFoundError(f"no documents in {self.path}")
        schema = StructType([*[f for f in snapshot.schema.fields if f.name != "batch"]])
        return self.live(self.read("documents", list(snapshot.batches) if batches is None else batches, schema.add("batch", "string")), snapshot)

    def write(self, batch: str, rows: DataFrame) -> None:
        """The folders of a batch, over what an earlier try left: documents, each file's by id, each with a number of its own, their texts in chunks, and the indexes."""
        target = f"{self.path}/documents/batch={batch}"
        rows.drop("batch", "ord").sortWithinPartitions("id").withColumn("ord", F.monotonically_increasing_id()).write.mode("overwrite").options(**BY_ID).parquet(target)
        written = self.spark.read.parquet(target)
        text = F.col("extracted_text") if "extracted_text" in written.columns else F.lit(None).cast("string")
        parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        chunks = written.select("id", F.posexplode(parts).alias("chunk", "text"))
        chunks.sortWithinPartitions("id", "chunk").write.mode("overwrite").options(**BY_ID).parquet(f"{self.path}/chunks/batch={batch}")
        indexes.postings(written).write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch}")
        indexes.bitmaps(written).write.mode("overwrite").parquet(f"{self.path}/bitmaps/batch={batch}")

    def _overlap(self, ids: DataFrame, snapshot: Snapshot, but: Sequence[str] = ()) -> dict:
        """What an entry lists as gone: the rows of these ids that count."""
        others = [b for b in snapshot.batches if b not in but]
        if not others:
            return {}
        rows = self.live(self.read("documents", others, "id long, ord long, batch string"), snapshot)
        ids = ids.select("id").distinct()
        few = ids.limit(MOST_STALE + 1).count() <= MOST_STALE
        return self._list(rows.join(F.broadcast(ids) if few else ids, "id", "left_semi"))

    def _list(self, rows: DataFrame) -> dict:
        name = f"rows-{uuid.uuid4().hex}"
        rows.select("id", "batch", "ord").write.parquet(f"{self.path}/gone/{name}")
        count = self.spark.read.parquet(f"{self.path}/gone/{name}").count()
        return {"gone": [name], "n_gone": count} if count else {}

    def add(self, batch: str, rows: DataFrame, instead: Sequence[str] = (), only_known: Column | None = None) -> None:
        """A batch of documents with different ids, which stand in for rows of these ids and for the batches instead. A batch that is in the log already is left as it is.

        What was removed of the batches instead is gone of the new one from the start, and so are rows of the condition only_known whose ids do not count any more.
        """
        if batch in self.snapshot().ever:
            return
        self.write(batch, rows)
        new = self.spark.read.parquet(f"{self.path}/documents/batch={batch}")
        schema = new.schema.json()
        counts = {r["status"]: r["count"] for r in new.groupBy("status").count().collect()} if "status" in new.columns else {}

        def change(seen: Snapshot) -> dict | None:
            if batch in seen.ever:
                return None
            late = self.gone(seen).where(F.col("batch").isin(*instead)).select("id")
            if only_known is not None:
                wanted = new.where(only_known).select("id")
                late = late.unionByName(wanted.join(self.rows(seen).select("id"), "id", "left_anti") if seen.batches else wanted)
            late = self._list(new.join(late, "id", "left_semi").select("id", F.lit(batch).alias("batch"), "ord"))
            ids = new.select("id")
            if late:
                ids = ids.join(self.spark.read.parquet(f"{self.path}/gone/{late['gone'][0]}"), "id", "left_anti")
            found = self._overlap(ids, seen, instead)
            both = {"gone": [*late.get("gone", []), *found.get("gone", [])], "n_gone": late.get("n_gone", 0) + found.get("n_gone", 0)}
            return {"add": {batch: schema}, "remove": [b for b in instead if b in seen.batches], "counts": counts, **both}

        self.commit(change)

    def delete(self, ids: DataFrame) -> None:
        """The documents of these ids (a column id) are gone for whoever reads later versions. Their bytes stay until purge()."""

        def change(seen: Snapshot) -> dict | None:
            return self._overlap(ids, seen) or None

        self.commit(change)

    def compact(self, batches: Sequence[str] | None = None) -> str | None:
        """Copy what counts of these batches into one, their files' bytes too; without a list, of all that have gone rows or share files with such. Gives the new batch.

        What others add or delete meanwhile keeps its effect.
        """
        base = self.snapshot()
        if batches is None:
            touched = {r["batch"] for r in self.gone(base).select("batch").distinct().collect()} & base.batches.keys()
            while touched and "landed" in base.schema.fieldNames():
                every = self.read("documents", list(base.batches), "landed string, batch string").distinct()
                files = every.where(F.col("batch").isin(*touched)).select("landed").distinct()
                more = {r["batch"] for r in every.join(files, "landed").select("batch").distinct().collect()} | touched
                if more == touched:
                    break
                touched = more
            batches = [b for b in base.batches if b in touched]
        if not batches:
            return None
        name = f"c{base.version:012d}-{uuid.uuid4().hex[:8]}"
        rows = self.rows(base).where(F.col("batch").isin(*batches))
        if "landed" in rows.columns:
            self._copy_files(rows, name)
            rows = rows.withColumn("landed", F.when(F.col("landed").isNotNull(), name))
        self.write(name, rows.repartitionByRange("id"))
        new = self.spark.read.parquet(f"{self.path}/documents/batch={name}")

        def change(seen: Snapshot) -> dict | None:
            if not set(batches) <= seen.batches.keys():
                return None
            left = self.gone(seen).where(F.col("batch").isin(*[b for b in seen.batches if b not in batches]))
            before = self.gone(base).select("batch", "ord")
            since = self.gone(seen).where(F.col("batch").isin(*batches)).join(before, ["batch", "ord"], "left_anti").select("id")
            late = new.join(since, "id", "left_semi").select("id", F.lit(name).alias("batch"), "ord")
            return {"add": {name: new.schema.json()}, "remove": batches, "base": True, **self._list(left.unionByName(late))}

        return name if self.commit(change) else None

    def _copy_files(self, rows: DataFrame, name: str) -> None:
        held = rows.select("id", "landed").where("landed IS NOT NULL")
        self.files(held).drop("landed").write.mode("overwrite").options(**LARGE_ROWS).parquet(f"{self.path}/originals/batch={name}")

    def files(self, wanted: DataFrame) -> DataFrame:
        """id, landed, path, length and content of the files of documents (id, landed)."""
        folders = [r["landed"] for r in wanted.select("landed").distinct().collect()]
        schema = "id long, path string, length long, content binary"
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, landed string")
        rows = self.read("originals", folders, f"{schema}, batch string").withColumnRenamed("batch", "landed")
        return rows.join(wanted.select("id", "landed"), ["id", "landed"], "left_semi")

    def purge(self) -> None:
        """Compact what has gone rows, then remove all folders that counted once and no longer do. Earlier versions can't be read after it."""
        self.compact()
        now = self.snapshot()
        held = set(now.batches)
        dead = sorted(now.ever - held)
        landed = [r["landed"] for r in self.rows(now).select("landed").distinct().collect()] if now.batches and "landed" in now.schema.fieldNames() else []
        for table in TABLES:
            self._remove(self._folders(table, dead))
        self._remove(self._folders("originals", [b for b in self._ever_landed(now) if b not in landed]))
        self._remove([f"{self.path}/gone/{g}" for g in self._names("gone") if g not in now.gone and g in self._ever_gone()])

    def _names(self, folder: str) -> list[str]:
        _, path, fs = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _ever_gone(self) -> set[str]:
        return {g for entry in self.entries() for g in entry["gone"]}

    def _ever_landed(self, now: Snapshot) -> list[str]:
        """Folders of files that a batch in the log was made of: a compaction's own, or those of an ingest that is complete."""
        complete = {b.rsplit("-", 1)[0] for b in now.ever if b.endswith("-3")} | {b for b in now.ever if b.startswith("c")}
        return [n.removeprefix("batch=") for n in self._names("originals") if n.removeprefix("batch=") in complete]

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            remove(self.spark, path)

    def row(self, key: int, *columns: str, snapshot: Snapshot | None = None) -> DataFrame:
        """These columns of one document: files and row groups are skipped by their ids, gone rows are those of this id."""
        snapshot = snapshot or self.snapshot()
        if not snapshot.batches:
            return self.spark.createDataFrame([], "id long")
        schema = StructType([f for f in snapshot.schema.fields if f.name != "batch"]).add("batch", "string")
        rows = self.read("documents", list(snapshot.batches), schema).where(F.col("id") == key)
        if snapshot.n_gone:
            rows = rows.join(F.broadcast(self.gone(snapshot).where(F.col("id") == key).select("batch", "ord")), ["batch", "ord"], "left_anti")
        return rows.select(*columns) if columns else rows

    def chunks(self, batch: str, key: int, first: int, last: int) -> DataFrame:
        """These chunks of a document's text, in order."""
        rows = self.read("chunks", [batch], "id long, chunk int, text string, batch string")
        return rows.where((F.col("id") == key) & F.col("chunk").between(first, last)).orderBy("chunk").select("chunk", "text")

