import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from papyra.engine import Engine
from papyra.operators.search import SearchParams
from papyra.streaming import ingest
from papyra.streaming.store import Store


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)
    return f"file://{folder}"


def plain(spark, *rows):
    """Documents of (id, text), with no more than a store needs."""
    return spark.createDataFrame(rows, "id long, extracted_text string").withColumns({"search_blob": F.col("extracted_text"), "landed": F.lit(None).cast("string")})


def texts(store, snapshot=None):
    return {r["id"]: r["extracted_text"] for r in store.rows(snapshot).select("id", "extracted_text").collect()}


def test_two_streams_and_a_new_checkpoint_lose_nothing(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    for name, check in (("a", "a"), ("b", "b"), ("c", "a2")):
        source = write(tmp_path / name, **{name: f"Note {name} of the safety meeting."})
        ingest.ingest_stream(spark, source, store, f"file://{tmp_path}/check-{check}").awaitTermination()
    engine = Engine(spark, store)
    found = {r["filename"]: r["id"] for r in engine.documents().select("filename", "id").collect()}
    assert found.keys() == {"a.txt", "b.txt", "c.txt"}
    assert engine.original(found["a.txt"]) == b"Note a of the safety meeting."


def test_deletion_whatever_the_zones(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TZ", "America/Los_Angeles")
    time.tzset()
    try:
        source = write(tmp_path / "in", a="Safety hazard report.", b="Invoice of a vendor.")
        engine = Engine(spark, f"file://{tmp_path}/store")
        engine.ingest(source)
        keys = {r["filename"]: r["id"] for r in engine.documents().select("filename", "id").collect()}
        engine.delete(spark.createDataFrame([(keys["a.txt"],)], "id long"))
        assert [r["filename"] for r in engine.documents().collect()] == ["b.txt"]
        engine.ingest(source)
        assert engine.documents().count() == 2
    finally:
        monkeypatch.undo()
        time.tzset()


def test_readers_see_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.add("one", plain(spark, (1, "a"), (2, "b")))
    first = store.snapshot()
    store.write("two", plain(spark, (2, "B"), (3, "c")))
    assert texts(store) == {1: "a", 2: "b"}
    store.add("two", plain(spark, (2, "B"), (3, "c")))
    store.delete(spark.createDataFrame([(1,)], "id long"))
    assert texts(store) == {2: "B", 3: "c"} and texts(store, first) == {1: "a", 2: "b"}
    assert texts(store, store.snapshot(2)) == {1: "a", 2: "B", 3: "c"}
    before = store.snapshot().version
    store.add("two", plain(spark, (9, "again")))
    store.delete(spark.createDataFrame([(77,)], "id long"))
    assert store.snapshot().version == before


def test_writers_at_once_all_count(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    store.add("one", plain(spark, (1, "a"), (2, "b"), (3, "c")))
    put, raced = Store._put, []

    def late(self, path, text):
        if self is store and not raced:
            raced.append(path)
            other.add("two", plain(spark, (2, "other"), (4, "d")))
        return put(self, path, text)

    monkeypatch.setattr(Store, "_put", late)
    store.add("three", plain(spark, (2, "mine"), (3, "C")))
    assert raced and texts(store) == {1: "a", 2: "mine", 3: "C", 4: "d"}
    raced.clear()
    monkeypatch.setattr(Store, "_put", lambda self, path, text: (raced or raced.append(1) or other.delete(spark.createDataFrame([(4,), (1,)], "id long")) or put(self, path, text)) if self is store and not raced else put(self, path, text))
    assert store.compact(list(store.snapshot().batches))
    assert texts(store) == {2: "mine", 3: "C"} and len(store.snapshot().batches) == 1


def test_what_is_removed_during_a_batch_stays_removed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.add("b-0", plain(spark, (1, "wait"), (2, "wait"), (3, "wait")))
    store.delete(spark.createDataFrame([(1,)], "id long"))
    store.add("newer", plain(spark, (2, "newer")))
    store.add("b-1", plain(spark, (1, "done"), (2, "done"), (3, "done")), ["b-0"], only_known=F.lit(True))
    assert texts(store) == {2: "newer", 3: "done"}


def test_a_batch_goes_on_after_a_failure_at_any_step(spark, tmp_path, monkeypatch):
    source = write(tmp_path / "in", a="Safety hazard report.", b="Invoice of a vendor.")
    engine = Engine(spark, f"file://{tmp_path}/store")
    add, calls, seen = Store.add, [], []

    def failing(self, batch, *rest, **options):
        calls.append(batch)
        if len(calls) in (1, 3, 6):
            self.write(batch, rest[0])
            raise OSError("lost")
        add(self, batch, *rest, **options)
        seen.append({r["status"] for r in self.rows().select("status").collect()})

    monkeypatch.setattr(Store, "add", failing)
    for _ in range(4):
        stream = ingest.ingest_stream(spark, source, engine.store, f"file://{tmp_path}/check")
        try:
            stream.awaitTermination()
        except Exception:
            continue
    assert {r["status"] for r in engine.documents().select("status").collect()} == {"analysis_complete"}
    assert engine.documents().count() == 2 and {"processing"} in seen and {"ai_analysis"} in seen
    assert len({*engine._store.snapshot().ever}) == 4


def everything(spark, folder):
    """All strings and bytes in all Parquet files below a folder."""
    found = []
    for top, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                found += [str(r.asDict(True)) for r in spark.read.parquet(f"file://{top}/{n}").collect()]
    return "\n".join(found)


def test_purged_texts_are_in_no_file(spark, tmp_path):
    source = write(tmp_path / "in", a="Zebra hazard report.", b="Quokka invoice of a vendor.", c="Okapi training note.")
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(source, uploaded_by="ann")
    keys = {r["filename"]: r["id"] for r in engine.documents().select("filename", "id").collect()}
    engine.reprocess([keys["b.txt"]])
    write(tmp_path / "in", c="Narwhal training note.")
    engine.ingest(source)
    engine.delete([keys["a.txt"]])
    assert "Zebra" in everything(spark, tmp_path / "store") and "Okapi" in everything(spark, tmp_path / "store")
    engine.purge()
    left = everything(spark, tmp_path / "store")
    assert "Zebra" not in left and "zebra" not in left and "Okapi" not in left
    assert {r["filename"]: r["extracted_text"] for r in engine.documents().collect()} == {"b.txt": "Quokka invoice of a vendor.", "c.txt": "Narwhal training note."}
    assert engine.original(keys["b.txt"]) == b"Quokka invoice of a vendor." and engine.search(SearchParams.of("narwhal")).paging.total == 1
    assert engine.stats().first()["total_documents"] == 2
    engine.reprocess([keys["c.txt"]])
    assert engine.detail(keys["c.txt"])["status"] == "analysis_complete"


def test_failed_files_are_known_by_name_alone(spark, tmp_path):
    source = write(tmp_path / "in", fine="All staff shall attend the training.")
    (tmp_path / "in" / "Safety circular broken.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "tool.exe").write_bytes(b"MZ")
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(source)
    row = {r["filename"]: r for r in engine.documents().collect()}["Safety circular broken.docx"]
    assert (row["status"], row["document_type"], row["summary"], row["department"], row["priority"], row["keywords"], row["language"]) == ("failed", "", "", "Unassigned", "Medium", [], "Unknown")
    assert row["analysis_confidence"] is None and row["processed_at"] is None and row["search_blob"] == "safety circular broken.docx" and row["error_message"]
    assert engine.search(SearchParams.of("readable text")).paging.total == 0
    assert {(r["facet"], r["value"]): r["count"] for r in engine.facets(SearchParams.of(filters={"status": "failed"})).collect()}[("priority", "Medium")] == 2


def test_lookups_read_what_they_need(spark, tmp_path):
    long = "".join(f"{i:07d} é" for i in range(30_000))
    store = Store(spark, f"file://{tmp_path}/store")
    store.add("one", plain(spark, (1, "a"), (2, long), (3, "c")).withColumn("char_count", F.length("extracted_text")))
    engine = Engine(spark, store.path)
    for offset, limit in ((0, 10), (8190, 5), (100_000, 20_000), (len(long) - 3, 10), (len(long) + 5, 10)):
        assert engine.text(2, offset, limit) == (long[offset : offset + limit], len(long), offset + limit < len(long))
    plan = store.row(2, "char_count")._jdf.queryExecution().toString()
    assert "EqualTo(id,2)" in plan and "extracted_text" not in plan.split("ReadSchema")[1]
    chunk = store.chunks("one", 2, 3, 4)
    assert "EqualTo(id,2)" in chunk._jdf.queryExecution().toString() and chunk.count() == 2
    with pytest.raises(KeyError):
        engine.text(99)


def test_instants_are_utc(spark):
    assert spark.range(1).select(ingest._now(datetime.fromisoformat("2024-01-01T02:00:00+02:00")).cast("string")).first()[0] == "2024-01-01 00:00:00"
