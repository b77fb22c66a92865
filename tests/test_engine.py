import io
import zipfile

import pytest

from papyra.engine import Engine
from papyra.operators.search import SearchParams


def docx(*paragraphs: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_ingest_search_and_delete(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "Safety_note.txt").write_text("Subject: Inspection of doors\nAll staff shall report hazard and near miss events by 30/09/2025.")
    (source / "Bill.docx").write_bytes(docx("Tax invoice for spare parts.", "Payment is due within 30 days of receipt."))
    (source / "broken.docx").write_bytes(b"no zip")
    (source / "tool.exe").write_bytes(b"MZ")
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(f"file://{source}")
    rows = {r["filename"]: r for r in engine.documents().collect()}
    assert rows["Safety_note.txt"]["title"] == "Inspection of doors" and rows["Safety_note.txt"]["department"] == "Safety"
    assert rows["Bill.docx"]["document_type"] == "Invoice" and rows["Bill.docx"]["page_count"] == 1
    assert {rows["broken.docx"]["status"], rows["tool.exe"]["status"]} == {"failed"}
    page = engine.search(SearchParams.of("hazard inspection"))
    assert page.paging.total == 1 and page.items.first()["filename"] == "Safety_note.txt"
    key = rows["Bill.docx"]["id"]
    assert engine.text(key, 0, 11)["text"] == "Tax invoice" and engine.original(key)[:2] == b"PK"
    engine.delete([key])
    with pytest.raises(KeyError):
        engine.detail(key)


def test_reprocessing_reads_the_stored_bytes_in_one_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"note [{i}].txt").write_text(f"Safety hazard report number {i} for the near miss register.")
    (source / "tool.exe").write_bytes(b"MZ")
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.ingest(f"file://{source}", uploaded_by="ann")
    before = {r["filename"]: r for r in engine.documents().collect()}
    for file in source.iterdir():
        file.unlink()
    key, gone = before["note _0_.txt"]["id"], before["note _1_.txt"]["id"]
    engine.delete([gone])
    engine.reprocess([key, gone, before["tool.exe"]["id"], 12345])
    after = {r["filename"]: r for r in engine.documents().collect()}
    assert after.keys() == before.keys() - {"note _1_.txt"}
    assert [after["note _0_.txt"][c] for c in ("uploaded_by", "uploaded_at", "status", "title")] == [before["note _0_.txt"][c] for c in ("uploaded_by", "uploaded_at", "status", "title")]
    assert after["tool.exe"]["status"] == "failed" and after["tool.exe"]["stored_filename"] is None
    assert engine.original(key) == b"Safety hazard report number 0 for the near miss register."
    assert len([line for line in (tmp_path / "store" / "log").glob("*.json")]) == 9


def test_documents_wait_before_they_are_read(spark, tmp_path):
    from papyra.sources import files
    from papyra.streaming import ingest, store

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Fire_drill.txt").write_text("All staff shall attend.")
    (tmp_path / "in" / "empty.txt").write_text("")
    rows = files.read_files(spark, f"file://{tmp_path}/in")
    store.Store(spark, f"file://{tmp_path}/store").add("a-0", ingest.waiting(rows, uploaded_by="ann"))
    engine = Engine(spark, f"file://{tmp_path}/store")
    (found,) = ingest.read_store(spark, engine.store).collect()
    assert (found["status"], found["title"], found["search_blob"], found["uploaded_by"]) == ("processing", "Fire Drill", "fire_drill.txt", "ann")
    assert ingest.waiting(rows.limit(0)).count() == 0
