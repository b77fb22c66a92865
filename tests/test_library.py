import json
import math
import random
import time
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.operators import rules
from papyra.operators.search import Paging, SearchParams, parse_terms, search, split_multi, total
from papyra.operators.facets import facets
from papyra.sources import library as lib


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms():
    assert parse_terms('The "Spare Parts" x a') == ["the", "spare parts"]
    assert parse_terms("x") == ["x"] and parse_terms("") == []
    assert len(parse_terms(" ".join(f"term{i}" for i in range(12)))) == 8
    assert split_multi(["Safety, Finance", "Safety"]) == ["Safety", "Finance"]


def test_params_and_paging():
    assert SearchParams.of("", sort="relevance").applied_sort() == "newest"
    assert SearchParams.of("x", sort="odd").applied_sort() == "relevance"
    with pytest.raises(ValueError):
        SearchParams.of(page_size=101)
    p = Paging(8, 3, 3)
    assert (p.total_pages, p.has_next, p.has_prev, p.showing()) == (3, False, True, (7, 8))


# Department, type, priority, first date, number of actions and risks, flags of each memo.
EXPECTED = [
    ("Safety", "Correspondence", "High", "30/09/2025", 2, 1, ["Mandatory"]),
    ("Finance", "Invoice", "Medium", "within 30 days", 1, 0, []),
    ("Procurement", "Tender / Contract", "Medium", "15 October 2025", 1, 0, []),
    ("HR", "HR Policy", "Low", None, 1, 0, []),
    ("Safety", "Incident Report", "High", "within 24 hours", 1, 1, []),
    ("Legal", "Legal Opinion", "Medium", "March 5, 2026", 1, 1, []),
    ("Civil / Track", "Other", "Medium", "5-10-2025", 1, 0, []),
    ("IT", "Other", "Low", None, 1, 0, []),
    ("Electrical", "Other", "Medium", None, 1, 1, []),
    ("Safety", "Safety Circular", "High", None, 0, 1, ["Audit", "Circular", "Directive", "Mandatory"]),
    ("Unassigned", "Correspondence", "Low", None, 0, 0, []),
]


def test_rules_on_memos(spark):
    rows = spark.createDataFrame([(i, "src0_en-0.pdf", m) for i, m in enumerate(lib.MEMOS)], "i int, filename string, extracted_text string")
    got = [(r.department, r.document_type, r.priority, r.deadlines[0].date if r.deadlines else None, len(r.actions), len(r.risks), r.compliance_flags) for r in rules.analysed(rows).orderBy("i").collect()]
    assert got == EXPECTED


def test_empty_document(spark):
    r = rules.analysed(spark.createDataFrame([("Tax_invoice-9.pdf", None)], "filename string, extracted_text string")).first()
    assert (r.title, r.document_type, r.analysis_confidence, r.department) == ("Tax Invoice 9", "Invoice", 0.15, "Unassigned")


def test_text_functions(spark):
    assert one(spark, t.safe_filename(F.lit("../../etc/pass(1).txt"))) == "pass_1_.txt"
    assert one(spark, t.clean(F.lit(" a\x00\t b\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, t.smart_cased(F.lit("NOTICE OF THE 112TH CBTC MEETING"))) == "Notice of the 112th CBTC Meeting"
    assert one(spark, t.title_from_filename(F.lit("report2b_non-compliance.pdf"))) == "Report2B Non Compliance"
    assert one(spark, t.phrase_count(t.tagged(F.lit("Nit monitoring, nit. unit")), "nit")) == 2
    assert one(spark, t.language(F.lit("സുരക്ഷാ പരിശോധന"))) == "Malayalam"
    wrapped = "This line is long enough to be taken for wrapped\ntext of one sentence.\n\nNew one."
    assert one(spark, t.reflow(F.lit(wrapped))) == "This line is long enough to be taken for wrapped text of one sentence.\nNew one."


def test_sizes_between_two_decimals(spark):
    from papyra.operators import display

    sizes = [6400, 2304, 2816, 10 * 1024 + 512, 11 * 1024 + 512, 6553600, 1, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "i int, x long").select("i", display.format_bytes(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["6.2 KB", "2.2 KB", "2.8 KB", "10 KB", "12 KB", "6.2 MB", "1 B", "—"]


def test_confidences_between_two_tenths():
    from papyra.sources import files

    # Means of 56.45, 52.55 and 49.85, the binary forms of which lie beside the middle.
    for total, mean in ((5645, 56.4), (5255, 52.6), (4985, 49.8)):
        assert files.ocr_text([("w", float(total))] + [("v", 0.0)] * 99 + [("x", -1.0)])[1] == mean


def test_page_table_has_confidences_between_two_tenths(spark):
    from papyra.sources import files
    from papyra.streaming import ingest

    decoders = {"PDF": lambda content: [(text, True, sure) for text, sure in [files.ocr_text([("w", float(n))] + [("v", 0.0)] * 99) for n in (4985, 4986, 5255)]], "IMAGE": lambda content: []}
    rows = files.extract(spark.createDataFrame([("/x/a.pdf", 1, b"x")], "path string, length long, content binary"), decoders).withColumn("id", F.lit(1).cast("long"))
    assert sorted((r.page_number, r.ocr_confidence) for r in ingest.pages(rows).collect()) == [(1, 49.8), (2, 49.9), (3, 52.6)]


def test_reflow_looks_at_each_line_once(spark):
    line = "Words of a paragraph that goes on and on and never ends"
    text = "\n".join([line] * 12_000 + ["", "  ", "SHORT", "BANNER OF CAPITALS THAT IS LONG ENOUGH TO BE TAKEN FOR A LINE", "next", line + ".", "last\u2003"])
    df = spark.createDataFrame([(text,), (None,), ("",), ("\n\n",)], "x string").coalesce(1)
    began = time.time()
    long, *rest = [r.x for r in df.select(t.reflow(F.col("x")).alias("x")).collect()]
    assert time.time() - began < 30
    assert long.split("\n") == [" ".join([line] * 12_000), "SHORT", "BANNER OF CAPITALS THAT IS LONG ENOUGH TO BE TAKEN FOR A LINE", "next", line + ".", "last"] and rest == [None, "", ""]


def _scans(df):
    """How often the plan goes through texts to replace or extract by patterns."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("regexp_replace(") + plan.count("regexp_extract_all(")


def test_texts_are_gone_through_once(spark):
    df = spark.createDataFrame([(["x"], [("s", "t")])], "xs array<string>, _sentences array<struct<s:string,tags:string>>")
    for function, scans in ((lambda x: t.trim_to(x, 9), 1), (t.upper_ratio, 2), (t.language, 2)):
        assert _scans(df.select(F.transform("xs", function).alias("x"))) == scans
    assert _scans(df.select(rules.deadlines().alias("x"))) == 1


def test_terms_by_count_and_first_place(spark):
    from collections import Counter

    rng = random.Random(3)
    pool = [*(rng.choice("abcxyz") * 2 + rng.choice("Qé-0k") + str(n % 37) for n in range(90)), "the", "The", "ab", "a-b", "aaa", "aaaa", "aaa-aaa", "സുരക്ഷാ", "9ab", "\n"]
    texts = ["", "the and", "word", *(" ".join(rng.choice(pool) for _ in range(rng.choice([3, 30, 800]))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, _body string")
    for r in rules.with_terms(rows.withColumn("tokens", t.tokens(F.col("_body")))).collect():
        assert r["_terms"] == [w for w, _ in Counter(r.tokens).most_common(rules.TERMS)]


def test_titles_of_capitals_with_marks_before_digits(spark):
    rows = [(1, 'OF "9233A8EC"!! THE (2ND TIINST!!'), (2, "THE 112TH OF 9233A8EC, '5BIS"), (3, "REPORT OF THE TRACK GMBH ßUNG")]
    df = spark.createDataFrame(rows, "id int, _raw string").withColumn("filename", F.lit("x.txt"))
    got = [r.title for r in rules.with_title(df).orderBy("id").collect()]
    assert got == ['Of "9233A8ec"!! the (2Nd Tiinst!!', "The 112th of 9233a8ec, '5Bis", "Report of the Track GMBH ẞung"]


def test_page_table_of_texts_with_form_feeds_and_what_xml_cannot_hold(spark, tmp_path):
    from papyra.plans import queries

    rows = [(2, "one\ftwo of it"), (1, "ab\ufffecd"), (17, "\x01")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:2] + tuple(r)[3:] for r in queries.page_table(spark, str(tmp_path)).orderBy("document_id", "page_number").collect()]
    assert got == [(1, 1, 13, False, None), (2, 1, 13, False, None), (2, 2, 13, True, 36.7), (2, 3, 10, False, None), (17, 1, 5, False, None)]


def test_search_treats_wildcards_as_text(spark):
    rows = [(1, "a_b 100%.pdf", "Safety", "x"), (2, "axb 1000.pdf", "IT", "y")]
    df = spark.createDataFrame(rows, "id long, filename string, department string, search_blob string")
    spec = lib.SearchSpec("id", {"filename": 50}, ("search_blob",), {"department": "department"}, name="filename", projection=("filename",))
    assert [r.id for r in search(df, spec, SearchParams.of("a_b")).collect()] == [1]
    assert total(df, spec, SearchParams.of("100%")).first()["total"] == 1
    found = facets(df, spec, SearchParams.of("", {"department": "Safety"}))
    assert {(r.value, r["count"]) for r in found.collect()} == {("Safety", 1), ("IT", 1)}


def test_facets_scan_once(spark):
    df = lib.library(spark, "/root/testdata/sf0.001")
    plan = facets(df, lib.LIBRARY, SearchParams.of("the", {"priority": "High"}, as_of=datetime(2024, 3, 30)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_highlights_of_whole_texts(spark, monkeypatch):
    from papyra.plans import queries

    late = "The track. " + "word " * 100 + "the INSPECTION"
    texts = spark.createDataFrame([(7, "word " * 100 + "Inspection"), (8, late), (9, "none")], "id long, extracted_text string")
    monkeypatch.setattr(lib, "library", lambda spark, sf_dir: texts)
    assert {r.id: r.hits for r in queries.highlights(spark, "").collect()} == {7: 1, 8: 3}


def test_highlights_take_the_first_term_at_a_place(spark):
    from papyra.operators import display

    def parts(text, terms):
        row = spark.createDataFrame([(text,)], "t string").select(display.highlighted(F.col("t"), terms).alias("p")).first()
        return [(p["text"], p["hit"]) for p in row.p]

    assert parts("On the way", ["the", "he"]) == [("On ", False), ("the", True), (" way", False)]
    assert parts("On the way", ["he", "th", "the", "a"]) == [("On ", False), ("th", True), ("e way", False)]
    assert parts("A.B (x) a.b", [" a.B ", "(X)"]) == [("A.B", True), (" ", False), ("(x)", True), (" ", False), ("a.b", True)]
    assert parts("short", ["s"]) == [("short", False)] and parts("", ["the"]) == []
    long = "y" * 300
    assert parts(f"a {long} bb", [long.upper(), "bb"]) == [("a ", False), (long, True), (" ", False), ("bb", True)]


def test_relative_time_rounds(spark):
    from datetime import datetime, timedelta

    from papyra.operators import display

    now = datetime(2024, 3, 30, 12)
    said = {29: "just now", 30: "1 min ago", 90: "2 min ago", 59 * 60 + 29: "59 min ago", 59 * 60 + 30: "1 hr ago", 90 * 60: "2 hr ago", 23 * 3600 + 30 * 60: "1 day ago", 36 * 3600: "2 days ago", 29 * 86400: "29 days ago", 30 * 86400: "29 Feb 2024", -5: "just now"}
    rows = spark.createDataFrame([(s, now - timedelta(seconds=s)) for s in said] + [(0, None)], "s int, t timestamp_ntz")
    got = {r.s: r.w for r in rows.select("s", display.relative_time(F.col("t"), now).alias("w")).collect()}
    assert got == {**said, 0: "—"}


def test_confidence_of_what_is_no_number(spark):
    rows = spark.createDataFrame([("abc",), (None,), ("-3",), ("0.456",), (" 2 ",)], "c string")
    assert [r[0] for r in rows.select(rules.as_confidence(F.col("c"))).collect()] == [None, None, 0.0, 0.46, 1.0]


def test_page_numbers_and_the_address_of_a_search():
    from papyra.operators.search import Paging, SearchParams, shown_terms

    assert Paging(61, 4, 10).window() == [1, 2, 3, 4, 5, 6, 7] and Paging(0, 1, 10).window() == []
    assert Paging(100, 1, 10).window() == [1, 2, None, 10] and Paging(100, 5, 10).window() == [1, None, 4, 5, 6, None, 10] and Paging(80, 7, 10).window() == [1, None, 6, 7, 8]
    params = SearchParams.of('a "b c"', {"department": ["IT", "HR"]}, "week", page=3, page_size=50)
    assert params.has_filters and not SearchParams.of("x").has_filters
    assert SearchParams.of_query(params.as_query(), ("department", "priority")) == params
    assert SearchParams.of_query("page=-2&page_size=900&page_size=1", ("department",)) == SearchParams.of(page_size=100) and SearchParams.of_query("page=x", ()) == SearchParams.of()
    assert params.filtered_by("department", []).filters == {} and params.filtered_by("priority", ["High"]).page == 1
    assert params.active({"date_range": {"week": "Last 7 days"}}) == [("department", "IT", "IT"), ("department", "HR", "HR"), ("date_range", "week", "Last 7 days")]
    assert shown_terms('The "big Dog" a "b') == ["The", "big Dog"]


def test_phrases_of_one_scan_are_those_of_each(spark):
    import re

    words = ["safety circular", "safety", "circular no", "near miss", "subject:", "scale 1:", "unsafety", "x", "as-built", "33kv", "the", "circular no.", "miss near"]
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice(words) + rng.choice((" ", ", ", "", "\n", "9")) for _ in range(20)) for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", t.phrases_in(F.col("t"), rules.PHRASES).alias("hits"))
    ask = ("safety circular", "safety", "near miss", "subject:", "scale 1:", "as-built", "33kv", "circular no")
    got = df.select("t", *[rules.signal_count(F.col("hits"), [a]).alias(f"n{i}") for i, a in enumerate(ask)]).collect()
    for r in got:
        assert list(r)[1:] == [len(re.findall(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", r.t)) for a in ask]


def test_fallback_to_the_rules(spark):
    rows = [("a.txt", "Tender document", '{"title": "", "department": "signaling", "confidence": "no"}', None), ("b.txt", "Tender document", "{broken", None), ("c.txt", "Tender document", None, "TimeoutError"), ("d.txt", " ", '{"department": "HR"}', "X"), ("e.txt", "Tender document", None, None)]
    got = rules.with_fallback(spark.createDataFrame(rows, "filename string, extracted_text string, reply string, error string"), "reply", "error").collect()
    assert [(r.department, r.analysis_engine) for r in got] == [("Signalling & Telecom", "model"), ("Procurement", "rule-based"), ("Procurement", "rule-based"), ("Unassigned", "rule-based"), ("Procurement", "rule-based")]
    assert [bool(r.analysis_error) for r in got] == [False, True, True, False, False] and "TimeoutError" in got[2].analysis_error
    assert got[0].title == "A" and got[0].summary == ""
    assert got[0].analysis_confidence is None


WRONG = ['{"actions":"x"}', '{"actions":[1]}', '{"deadlines":{"a":1}}', '{"keywords":7}', '{"department":5}', '{"secondary_departments":[1]}', '{"priority":["High"]}', "[]", "null", "7", '"text"', "", "no json"]
RIGHT = ["{}", '{"actions":null,"deadlines":[],"keywords":false}', '{"actions":[{"action":"go"}]}', '{"keywords":["a",2],"department":""}', '{"secondary_departments":["HR","IT"],"confidence":"nan"}']


def test_replies_of_the_wrong_shape_are_left_to_the_rules(spark):
    rows = [("a.txt", "Tender document", r, None) for r in WRONG + RIGHT]
    got = rules.with_fallback(spark.createDataFrame(rows, "filename string, extracted_text string, reply string, error string"), "reply", "error").collect()
    engines = {r.reply: (r.analysis_engine, r.department) for r in got}
    assert {engines[r] for r in WRONG} == {("rule-based", "Procurement")} and {engines[r] for r in RIGHT} == {("model", "Unassigned")}
    assert all(bool(r.analysis_error) == (r.reply in WRONG) for r in got) and all(r.extracted_text == "Tender document" for r in got)
    assert [a.action for a in next(r for r in got if "go" in r.reply).actions] == ["go"]
    assert math.isnan(next(r for r in got if "nan" in r.reply).analysis_confidence)


def test_a_model_that_fails_stalls_and_answers(spark, tmp_path):
    from papyra.operators import model

    log = tmp_path / "asked"
    log.mkdir()

    def ask(request):
        asked = json.loads(request)
        name = asked["filename"]
        (log / f"{name}-{uuid.uuid4().hex}").touch()
        tries = len(list(log.glob(f"{name}-*")))
        if name == "stalls.txt":
            time.sleep(8)
        if name == "never.txt" or (name == "second.txt" and tries < 2):
            raise ConnectionError("down")
        return json.dumps({"title": f"{asked['truncated']} {len(asked['text'])} {asked['page_count']}", "actions": 1 if name == "wrong.txt" else []})

    names = ("fine.txt", "second.txt", "never.txt", "stalls.txt", "wrong.txt")
    rows = [(n, f"Tender document {n}", 3) for n in names] + [("long.txt", "x" * 60_001, None), ("empty.txt", " ", 1), ("fine.txt", "Tender document fine.txt", 3)]
    df = spark.createDataFrame(rows, "filename string, extracted_text string, page_count int").coalesce(2)
    options = {"cache": f"file://{tmp_path}/cache", "attempts": 2, "wait": 0.01, "most_seconds": 3.0}
    got = rules.with_fallback(model.replies(df, ask, **options), "reply", "error").collect()
    by = {r.filename: r for r in got}
    assert len(got) == 8 and {n: (by[n].analysis_engine, by[n].error) for n in by} == {"fine.txt": ("model", None), "second.txt": ("model", None), "never.txt": ("rule-based", "ConnectionError"), "stalls.txt": ("rule-based", "TimeoutError"), "wrong.txt": ("rule-based", None), "long.txt": ("model", None), "empty.txt": ("rule-based", None)}
    assert by["long.txt"].title == "true 60000 None" or by["long.txt"].title == "True 60000 None"
    assert by["fine.txt"].title == "False 24 3" and len(list(log.glob("fine.txt-*"))) == 1 and not list(log.glob("empty.txt-*"))
    assert model.replies(df, ask, **options).where("filename = 'never.txt' OR filename = 'second.txt'").where("reply IS NOT NULL").count() == 1
    assert len(list(log.glob("fine.txt-*"))) == 1 and len(list(log.glob("second.txt-*"))) == 2


def test_a_page_whose_recognition_fails_keeps_its_file(spark):
    from papyra.sources import files

    def broken():
        raise ValueError("malformed")

    def recognise(number):
        if number in (1, 2):
            raise OSError("engine")
        return "recognised text of a page", 70.0

    decoders = {"PDF": lambda content: files.with_ocr(["n" * 50, "own", broken, "", ""], recognise, budget=1), "IMAGE": lambda content: []}
    (row,) = files.extract(spark.createDataFrame([("/x/a.pdf", 1, b"x")], "path string, length long, content binary"), decoders).collect()
    assert row.reason is None and row.warnings == "OCR failed on page 2. OCR failed on page 3."
    assert [(p.text, p.ocr_used) for p in row.pages] == [("n" * 50, False), ("own", False), ("", False), ("recognised text of a page", True), ("", False)]
    assert row.extraction_method == "pdf-text+ocr" and row.ocr_quality == 70.0 and row.page_count == 5


def test_files_that_are_refused_or_broken(spark):
    from papyra.sources import files

    docx = files.docx_of(["one", " ", "two"], [["a", " ", "b"], [" "]])
    rows = [("/x/a.txt", 3, "é\0b".encode() + b"\xff"), ("/x/none.txt", 0, b""), ("/x/big.txt", files.MOST_BYTES + 1, b"x"), ("/x/t.exe", 2, b"MZ"), ("/x/d.docx", len(docx), docx), ("/x/broken.docx", 3, b"zip"), ("/x/p.pdf", 1, b"p"), ("/x/i.png", 1, b"i"), ("/x/noext", 1, b"n")]
    got = {r.filename: r for r in files.extract(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    assert got["a.txt"].extracted_text == "é b\ufffd" and got["a.txt"].page_count == 1 and len(got["a.txt"].pages) == 1
    assert {n: got[n].reason for n in ("none.txt", "big.txt", "t.exe", "noext")} == {"none.txt": "empty file", "big.txt": "over 40 MB", "t.exe": "unsupported type", "noext": "unsupported type"}
    assert got["d.docx"].extracted_text == "one\ntwo\na | b" and got["d.docx"].page_count == 1
    assert got["broken.docx"].reason and got["p.pdf"].reason == "no decoder for PDF files"
    assert got["i.png"].reason is None and "OCR is unavailable" in got["i.png"].warnings
    pages = files.with_ocr(["x" * 40, "", "short", "s"], lambda i: ("seen it all here", 80.0) if i != 2 else ("no", 9.0), budget=2)
    assert [(p[1], p[2]) for p in pages] == [(False, None), (True, 80.0), (False, None), (False, None)]
    assert files.extract(spark.createDataFrame([], "path string, length long, content binary")).count() == 0


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    from papyra.sources import library

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    dealt = library.spread(rows)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(100))
    monkeypatch.setattr(library, "SMALL_BYTES", 10)
    assert library.spread(rows) is rows
    assert library.spread(spark.range(3)).count() == 3
