import random
import time

from pyspark.sql import functions as F

from papyra.engine import Engine
from papyra.operators import facets
from papyra.streaming import ingest, live, progress
from papyra.streaming.store import Store

COLUMNS = "id long, status string, department string, priority string, page_count int, actions array<string>"


def documents(spark, rng, ids):
    """Invented documents, some with nulls in every column but the id."""
    pick = lambda *of: rng.choice(of)
    rows = [(i, pick("analysis_complete", "analysis_complete", "failed", "processing", None), pick("Safety", "Finance", "Unassigned", "", None), pick("High", "Low", None), pick(None, 0, 3), pick(None, [], ["a", "b"])) for i in ids]
    return spark.createDataFrame(rows, COLUMNS).withColumns({"extracted_text": F.lit("x"), "search_blob": F.lit("x"), "landed": F.lit(None).cast("string")})


def figures_of(df):
    return df.first().asDict()


def test_figures_follow_whatever_is_written(spark, tmp_path):
    rng = random.Random(7)
    store, target = Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/figures"
    assert figures_of(live.figures(store, target)) == {"version": 0, "total_documents": 0, "complete": 0, "failed": 0, "high_priority": 0, "departments": 0, "pages": 0, "actions": 0, "in_progress": 0}
    steps = ["add", "delete", "add", "compact", "delete", "batch", "unseen", "purge", "add"]
    for number, step in enumerate(steps):
        ids = rng.sample(range(12), 4)
        if step in ("add", "unseen"):
            store.add(f"b{number}", documents(spark, rng, ids))
        elif step == "batch":
            store.add("t-0", documents(spark, rng, ids))
            store.add("t-1", documents(spark, rng, ids), ["t-0"], only_known=F.lit(True))
        elif step == "delete":
            store.delete(spark.createDataFrame([(i,) for i in ids], "id long"))
        else:
            getattr(store, step)()
        if step == "unseen":
            continue
        live.refresh(store, target)
        got = figures_of(live.figures(store, target))
        assert got.pop("version") == store.snapshot().version
        assert got == figures_of(facets.stats(store.rows())), (number, step)
    assert len(live._states(store, target)) == 2
    assert live.refresh(store, target) == store.snapshot().version


def test_changes_between_versions(spark, tmp_path):
    rng = random.Random(1)
    store = Store(spark, f"file://{tmp_path}/store")
    assert live.changes(store, 0).count() == 0
    store.add("one", documents(spark, rng, [1, 2, 3]))
    store.add("two", documents(spark, rng, [2, 4]))
    store.compact()
    store.delete(spark.createDataFrame([(1,), (4,)], "id long"))
    of = lambda since, until=None: sorted((r["id"], r["change"]) for r in live.changes(store, since, until).select("id", "change").collect())
    assert of(0, 1) == [(1, 1), (2, 1), (3, 1)] and of(1, 2) == [(2, -1), (2, 1), (4, 1)]
    assert live.changes(store, 2, 3).count() == 0 and of(3) == of(2) == [(1, -1), (4, -1)]
    assert of(1, 4) == [(1, -1), (2, -1), (2, 1), (4, -1), (4, 1)]
    assert live.changes(store, 4).count() == 0
    store.purge()
    assert live.changes(store, 4).count() == 0


def test_a_stream_of_the_log_keeps_figures(spark, tmp_path):
    rng = random.Random(2)
    store, target = Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/figures"
    for number in range(3):
        store.add(f"b{number}", documents(spark, rng, range(number, number + 3)))
        live.follow(store, target, f"file://{tmp_path}/check").awaitTermination()
        assert figures_of(live.figures(store, target)) == {"version": number + 1, **figures_of(facets.stats(store.rows()))}
    live.follow(store, target, f"file://{tmp_path}/new").awaitTermination()
    assert figures_of(live.figures(store, target))["total_documents"] == 5


def test_each_status_is_seen(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.txt", b"Safety hazard report."), ("b.docx", b"no zip"), ("scan.png", b"image"), ("tool.exe", b"MZ")):
        (tmp_path / "in" / name).write_bytes(content)
    store = Store(spark, f"file://{tmp_path}/store")
    log = progress.ArrivalLog(store)
    spark.streams.addListener(log)
    try:
        decoders = {"IMAGE": lambda content: [("Notice of a meeting.", True, 90.0)]}
        ingest.ingest_stream(spark, f"file://{tmp_path}/in", store.path, f"file://{tmp_path}/check", decoders=decoders).awaitTermination()
        for _ in range(60):
            if arrived := progress.arrivals(spark, store).collect():
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    assert [(r["number"], r["files"], r["refused"], r["bytes"]) for r in arrived] == [(0, 4, 1, 34)]
    by_stage = {}
    for r in progress.history(store).collect():
        by_stage.setdefault(r["stage"], {})[r["status"]] = r["documents"]
    assert by_stage == {0: {"processing": 3}, 1: {"processing": 2, "ocr_processing": 1}, 2: {"ai_analysis": 2, "failed": 2}, 3: {"analysis_complete": 2, "failed": 2}}
    engine = Engine(spark, store.path)
    (row,) = engine.uploads().collect()
    assert (row["documents"], row["complete"], row["failed"], row["in_progress"], row["percent"], row["finished"]) == (4, 2, 2, 0, 100, True)
    seen = {r["filename"]: (r["status_label"], r["error"]) for r in engine.poll(engine.documents().select("id")).collect()}
    assert seen["a.txt"] == ("AI Analysis Complete", None) and seen["b.docx"][0] == "Failed" and seen["b.docx"][1]
    assert engine.poll([1]).count() == 0


def test_progress_as_it_comes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert progress.history(store).count() == 0 and progress.uploads(store).count() == 0 and progress.poll(store, [1]).count() == 0
    rows = spark.createDataFrame([(1, "processing"), (2, "failed"), (3, "analysis_complete")], "id long, status string").withColumns({"extracted_text": F.lit("x"), "search_blob": F.lit("x")})
    store.add("t1-0", rows)
    assert progress.uploads(store).select("upload", "stage", "in_progress", "percent", "finished").first()[:] == ("t1", 0, 1, 66, False)
    query = progress.watch(store).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["upload"], r["status"], r["documents"]) for r in spark.table("watched").collect()} == {("t1", "processing", 1), ("t1", "failed", 1), ("t1", "analysis_complete", 1)}
    store.delete(spark.createDataFrame([(2,)], "id long"))
    store.compact()
    assert progress.history(store).count() == 3
