"""Documents from files: text, DOCX and, where a decoder is installed, PDF and images.

Files are read as binary rows, once: one pass over them in small batches decodes
text and DOCX by the standard library, PDF and images by decoders that are plugged
in by kind. A file is one row throughout, its pages an array, so nothing is
shuffled. Files that cannot be read become rejects with a reason.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.plans.workers import small_batches

# Supported extensions and limits.
TEXT_EXTENSIONS = ("txt", "md", "csv", "log", "json")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp")
DOC_EXTENSIONS = ("docx", "doc")
PDF_EXTENSIONS = ("pdf",)
SUPPORTED = (*TEXT_EXTENSIONS, *IMAGE_EXTENSIONS, *DOC_EXTENSIONS, *PDF_EXTENSIONS)
MOST_BYTES = 40 * 1024 * 1024
SCANNED_CHARS, OCR_PAGES, PAGE_WORDS = 40, 25, 500

#: Pages of a file: (text, whether by OCR, confidence of the OCR) and, if there is one, a warning. Raises where a file is broken.
Page = tuple[str, bool, float | None] | tuple[str, bool, float | None, str | None]
Decoder = Callable[[bytes], list[Page]]
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of all files under a folder, or of one file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def gate() -> Column:
    """Why a file is refused, null if it is not."""
    return F.when(~t.file_extension(F.col("path")).isin(*SUPPORTED), "unsupported type").when(F.col("length") == 0, "empty file").when(F.col("length") > MOST_BYTES, "over 40 MB")


def facts(files: DataFrame, *held: str) -> DataFrame:
    """held and what is known of files before they are read: path, filename, file_type, file_ext, size_bytes, checksum, refused (why, else null), content (of files that are not refused)."""
    path = F.col("path")
    return files.select("path", t.safe_filename(path).alias("filename"), t.file_type(path).alias("file_type"), t.file_extension(path).alias("file_ext"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("checksum"), gate().alias("refused"), F.when(gate().isNull(), F.col("content")).alias("content"), *held)


def docx_pages(content: bytes) -> list[tuple[str, bool, float | None]]:
    """Paragraphs with text, then table rows as cells between bars; one page."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    if body is None:
        raise ValueError("no body")

    def words(node) -> str:
        marks = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{w}t" else marks.get(x.tag, "") for x in node.iter())

    lines = [s for p in body.findall(f"{w}p") if (s := words(p)).strip()]
    for row in body.iterfind(f"{w}tbl/{w}tr"):
        cells = [s for c in row.findall(f"{w}tc") if (s := "\n".join(words(p) for p in c.findall(f"{w}p")).strip())]
        lines += [" | ".join(cells)] * bool(cells)
    return [("\n".join(lines), False, None)]


def xml_text(text: str) -> str:
    """Without the characters that XML cannot hold, and without line ends."""
    return re.sub("[\x00-\x08\n-\x1f\ufffe\uffff]", "", text)


def docx_of(paragraphs: list[str], rows: list[list[str]]) -> bytes:
    """A plain document of paragraphs and a table, such as docx_pages() reads."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def put(parent, text: str) -> None:
        ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(parent, f"{w}p"), f"{w}r"), f"{w}t").text = xml_text(text)

    top = ElementTree.Element(f"{w}document")
    body = ElementTree.SubElement(top, f"{w}body")
    for text in paragraphs:
        put(body, text)
    table = ElementTree.SubElement(body, f"{w}tbl")
    for cells in rows:
        row = ElementTree.SubElement(table, f"{w}tr")
        for text in cells:
            put(ElementTree.SubElement(row, f"{w}tc"), text)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", ElementTree.tostring(top, "utf-8"))
    return data.getvalue()


def text_pages(content: bytes) -> list[tuple[str, bool, float | None]]:
    return [(content.decode("utf-8", "replace"), False, None)]


def ocr_text(tokens: list[tuple[str, float]]) -> tuple[str, float | None]:
    """Text of recognised words and their mean confidence, in tenths, of two as near the even one; negative confidences do not count."""
    words = [(w.strip(), c) for w, c in tokens if w.strip()]
    sure = [c for _, c in words if c >= 0]
    # Not round(mean, 1), which takes 52.55 for a little less, as its binary form is.
    return " ".join(w for w, _ in words), round(sum(sure) / len(sure) * 10) / 10 if sure else None


def _clean(text: str) -> str:
    """functions.text.clean() for what is compared before it is a row."""
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text.replace("\0", " "))).strip()


def _native(page: str | Callable[[], str]) -> str:
    try:
        return _clean(page if isinstance(page, str) else page())
    except Exception:
        return ""


def with_ocr(native: Sequence[str | Callable[[], str]], recognise: Callable[[int], tuple[str, float | None]] | None, budget: int = OCR_PAGES) -> list[Page]:
    """Pages; those with hardly any text of their own are recognised while the budget lasts, and that kept if longer.

    A page is its text or a function that gives it; one that cannot is empty. Where
    recognition fails a page keeps its own text, with a warning, and the budget stays as it was.
    """
    pages: list[Page] = []
    for number, text in enumerate(map(_native, native)):
        page: Page = (text, False, None)
        if len(text) < SCANNED_CHARS and recognise and budget > 0:
            try:
                seen, sure = recognise(number)
                if len(_clean(seen)) > len(text):
                    page = (_clean(seen), True, sure)
                budget -= 1
            except Exception:
                page = (text, False, None, f"OCR failed on page {number + 1}.")
        pages.append(page)
    return pages


_PAGES = "array<struct<page_number:int,text:string,ocr_used:boolean,ocr_confidence:double>>"


def _decoded(files: DataFrame, decoders: dict[str, Decoder]) -> DataFrame:
    """files with pages, page_warnings and error in place of content. Refused files have no content and no pages, as have images where there is no decoder."""
    small_batches(files.sparkSession)
    plugged = {"TXT": text_pages, "DOCX": docx_pages, "IMAGE": lambda content: [], **decoders}
    names = [c for c in files.columns if c != "content"]
    kinds = pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string()), ("ocr_used", pa.bool_()), ("ocr_confidence", pa.float64())]))

    def pages_of(kind: str, content: bytes | None) -> tuple[list, str | None, str | None]:
        if content is None:
            return [], None, None
        try:
            if kind not in plugged:
                raise ValueError(f"no decoder for {kind} files")
            pages = list(plugged[kind](content))
            return [(i, *page[:3]) for i, page in enumerate(pages, 1)], " ".join(p[3] for p in pages if len(p) > 3 and p[3]) or None, None
        except Exception as e:
            return [], None, str(e)[:1000] or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pages_of(kind.as_py(), content.as_py()) for kind, content in zip(batch["file_type"], batch["content"], strict=True)]
            pages = pa.array([[dict(zip(("page_number", "text", "ocr_used", "ocr_confidence"), p, strict=True)) for p in pages] for pages, _, _ in found], kinds)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pages, *(pa.array([x[i] for x in found], pa.string()) for i in (1, 2))], names=[*names, "pages", "page_warnings", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")
    return files.mapInArrow(run, f"{schema}, pages {_PAGES}, page_warnings string, error string")


def extract(files: DataFrame, decoders: dict[str, Decoder] | None = None, *held: str) -> DataFrame:
    """One row per file: held, path, filename, file_type, file_ext, size_bytes, checksum, extracted_text, pages, page_count, ocr_used, ocr_quality, extraction_method, language, word_count, char_count, warnings, reason (of a reject, else null)."""
    decoders = decoders or {}
    rows = _decoded(facts(files, *held), decoders)
    pdf, docx, image = (F.col("file_type") == k for k in ("PDF", "DOCX", "IMAGE"))
    clean = F.transform("pages", lambda p: p.withField("text", t.clean(p["text"])))
    rows = rows.withColumn("pages", F.filter(clean, lambda p: pdf | image | (p["text"] != "")))
    joined = F.array_join(F.transform(F.filter("pages", lambda p: p["text"] != ""), lambda p: p["text"]), "\n\n")
    rows = rows.withColumns({"extracted_text": t.clean(joined), "_scanned": F.filter("pages", lambda p: p["ocr_used"])})
    words, scanned = t.word_count(F.col("extracted_text")), F.size("_scanned")
    by_words = F.when(words > 0, F.greatest(F.lit(1), F.bround(words / PAGE_WORDS).cast("int")))
    sure = F.filter(F.transform("_scanned", lambda p: p["ocr_confidence"]), lambda c: c.isNotNull())
    read = F.coalesce("refused", "error").isNull()
    empty = F.col("extracted_text") == ""
    nothing = F.when(image, "No readable text was found in this image." if "IMAGE" in decoders else "OCR is unavailable on this server; image text was not read.")
    nothing = nothing.when(pdf, "No text could be extracted from this PDF, even with OCR." if "IMAGE" in decoders else "This PDF has no text layer and OCR is unavailable on this server.")
    rows = rows.withColumns({
        "page_count": F.when(read, F.when(docx, by_words).when(pdf, F.size("pages")).otherwise(1)),
        "ocr_used": scanned > 0,
        "ocr_quality": F.round(F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(sure), F.lit(0)), 1),
        "extraction_method": F.when(read, F.when(docx, "docx").when(image, "ocr").when(~pdf, "plain-text").when(scanned == 0, "pdf-text").when(scanned < F.size("pages"), "pdf-text+ocr").otherwise("ocr")),
        "language": t.language(F.col("extracted_text")), "word_count": words, "char_count": F.length("extracted_text"),
        "warnings": F.nullif(F.concat_ws(" ", "page_warnings", F.when(read & empty, nothing)), F.lit("")), "reason": F.coalesce("refused", "error"),
    })
    return rows.drop("refused", "error", "page_warnings", "_scanned")


def decoders_available() -> dict[str, bool]:
    """Which optional decoders are installed here."""
    from importlib.util import find_spec

    return {"pdf": find_spec("pypdf") is not None, "ocr": find_spec("pytesseract") is not None and find_spec("PIL") is not None, "docx": True}


def is_supported(filename: str) -> bool:
    return bool(m := re.search(r"[^./\\]\.([^./\\]+)$", filename)) and m[1].lower() in SUPPORTED
