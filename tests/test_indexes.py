import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import facets, indexes, search
from papyra.operators.search import SearchParams
from papyra.sources import library as lib

SF = "/root/testdata/sf0.001"
P = SearchParams.of


@pytest.fixture(scope="module")
def rows(spark):
    """The library in three batches, numbered apart in each."""
    df = lib.library(spark, SF).withColumns({"batch": F.concat(F.lit("b"), F.col("id") % 3), "ord": F.col("id") * 1000, "actions": F.array_repeat(F.lit("x"), (F.col("id") % 5).cast("int"))})
    return df.cache()


@pytest.fixture(scope="module")
def postings(rows):
    parts = [indexes.postings(rows.where(F.col("batch") == b)).withColumn("batch", F.lit(b)) for b in ("b0", "b1", "b2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).cache()


@pytest.fixture(scope="module")
def bitmaps(rows):
    parts = [indexes.bitmaps(rows.where(F.col("batch") == b)).withColumn("batch", F.lit(b)) for b in ("b0", "b1", "b2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).cache()


@pytest.mark.parametrize("query", ["the that", '"the inspection" of', "track inspection tamping", "src1_en 100% a_b", "സുരക്ഷാ", '"സുരക്ഷാ പരിശോധന" hazard', "of a", "th", "zzzzqq", "é", "INVOICE Payment", '".pdf"', "src1_en"])
def test_postings_find_what_the_scan_finds(rows, postings, query):
    terms = search.parse_terms(query)
    found = indexes.candidates(postings, terms, "batch")
    some = rows if found is None else rows.join(found.withColumnRenamed("place", "ord"), ["batch", "ord"], "left_semi")
    ids = lambda df: sorted(r["id"] for r in search.filtered(df, lib.LIBRARY, P(query)).select("id").collect())
    assert ids(some) == ids(rows)
    assert (found is None) == all(len(t) < 3 for t in terms)
    if found is not None and query != "the that":
        assert some.count() < rows.count() / 2


def test_trigrams_are_code_points():
    assert indexes.trigrams("ab").size == 0 and indexes.trigrams("").size == 0
    assert len(indexes.trigrams("a🙂b🙂a🙂b")) == 4 and len(indexes.trigrams("aaaa")) == 1


def test_postings_read_narrow_columns_only(spark, tmp_path, rows):
    indexes.postings(rows).write.parquet(f"{tmp_path}/p")
    plan = indexes.candidates(spark.read.parquet(f"{tmp_path}/p"), ["inspection"])._jdf.queryExecution().toString()
    assert "In(trigram" in plan or "EqualTo(trigram" in plan


@pytest.mark.parametrize("rows_first", [1, 64])
@pytest.mark.parametrize("params", [P("the that"), P("the that", page=3), P("inspection of", sort="newest", page_size=7), P("the", sort="priority"), P("the", sort="name", page=2, page_size=5), P('"the inspection"', {"department": "Safety,Finance"}), P("zzzzqq"), P("th e", sort="oldest"), P("the", page=99), P("pdf src1")], ids=str)
def test_ranked_pages_are_those_of_search(rows, monkeypatch, params, rows_first):
    monkeypatch.setattr(search, "FIRST_ROWS", rows_first)
    want = [tuple(r) for r in search.search(rows, lib.LIBRARY, params).collect()]
    assert [tuple(r) for r in search.ranked(rows, lib.LIBRARY, params).collect()] == want


def test_few_texts_are_read(spark, tmp_path, rows, monkeypatch):
    """Of rows whose names differ in score, the top page is found without the texts of the others."""
    looked, filtered = [], search.filtered
    monkeypatch.setattr(search, "filtered", lambda df, spec, params: looked.append(params) or filtered(df, spec, params))
    monkeypatch.setattr(search, "FIRST_ROWS", 4)
    got = search.ranked(rows, lib.LIBRARY, P("src0 pdf", page_size=3))
    assert got.count() == 3 and sum(bool(p.q) for p in looked) <= 4


PARAMS = [P(), P(filters={"department": "Safety,Finance", "priority": "High", "status": "complete"}), P("inspection the", {"file_type": "pdf"}, date_range="recent", as_of=lib.AS_OF), P(filters={"status": "nonsense"}), P("zzzzqq", {"priority": "Low"})]


@pytest.mark.parametrize("params", PARAMS, ids=str)
@pytest.mark.parametrize("some_gone", [False, True])
def test_bitmap_facets_are_those_of_the_scan(rows, bitmaps, params, some_gone):
    gone = rows.where("id % 7 = 3").select("batch", "ord") if some_gone else None
    live = rows.where("id % 7 <> 3") if some_gone else rows
    hits = None
    if params.q or any(search.date_bounds(params)):
        hits = search.filtered(live, lib.LIBRARY, SearchParams(params.q, date_range=params.date_range, as_of=params.as_of)).select("batch", "ord")
    get = lambda df: sorted((r["facet"], r["value"], r["label"], r["count"]) for r in df.collect())
    assert get(indexes.facets(bitmaps, lib.LIBRARY, params, gone=gone, hits=hits)) == get(facets.facets(live, lib.LIBRARY, params))


@pytest.mark.parametrize("some_gone", [False, True])
def test_bitmap_figures_are_those_of_the_scan(rows, bitmaps, some_gone):
    gone = rows.where("id % 7 = 3").select("batch", "ord") if some_gone else None
    live = rows.where("id % 7 <> 3") if some_gone else rows
    want = facets.stats(live).first().asDict()
    assert indexes.stats(bitmaps, gone=gone).first().asDict() == want


def test_bitmaps_of_random_rows(spark):
    rng = random.Random(3)
    data = [(i * 17, rng.choice(["A", "B", None, ""]), rng.choice(["High", "Low"]), rng.choice([None, 0, 3, 70_000])) for i in range(5000)]
    df = spark.createDataFrame(data, "ord long, department string, priority string, page_count int").withColumn("batch", F.lit("b"))
    bits = indexes.bitmaps(df).withColumn("batch", F.lit("b"))
    spec = search.SearchSpec("ord", {}, (), {"department": "department", "priority": "priority"})
    got = {(r["facet"], r["value"]): r["count"] for r in indexes.facets(bits, spec, P(filters={"department": "A"})).collect()}
    want = {("department", x): sum(d[1] == x for d in data) for x in ("A", "B")} | {("priority", x): sum(d[1] == "A" and d[2] == x for d in data) for x in ("High", "Low")}
    assert got == want
    assert indexes.stats(bits).first()["pages"] == sum(d[3] or 0 for d in data)


@pytest.mark.parametrize("params", [P(sort="newest", page_size=7), P("the", page_size=9), P("the", sort="priority", page_size=20), P(sort="name", page_size=33), P("of", {"priority": "High"}, sort="oldest", page_size=4)], ids=str)
def test_pages_after_cursors_are_those_by_number(rows, params):
    got, cursor = [], None
    while True:
        page = search.after(rows, lib.LIBRARY, params, cursor, "key")
        found = [r["id"] for r in page.collect()]
        if not found:
            break
        got += found
        cursor = search.cursor(page, lib.LIBRARY, params, "key")
        if len(got) > 60:
            break
    want = [r["id"] for r in search.search(rows, lib.LIBRARY, P(params.q, params.filters, sort=params.sort, page_size=100)).collect()]
    assert got[:60] == want[:60]


def test_cursors_with_nulls_and_foreign_ones(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5, None if i % 4 == 0 else f"n{i % 2}") for i in range(40)], "id long, stamp int, name string").withColumn("at", F.expr("timestampadd(DAY, stamp, TIMESTAMP_NTZ'2024-01-01')"))
    spec = search.SearchSpec("id", {}, (), timestamp="at", name="name")
    for sort in ("newest", "oldest", "name"):
        params, got, cursor = P(sort=sort, page_size=6), [], None
        while found := (page := search.after(df, spec, params, cursor, "key")).collect():
            got += [r["id"] for r in found]
            cursor = search.cursor(page, spec, params, "key")
        assert got == [r["id"] for r in search.search(df, spec, P(sort=sort, page_size=100)).collect()] and len(got) == 40
    with pytest.raises(ValueError):
        search.after(df, spec, P(sort="newest", page_size=6), search.cursor(search.after(df, spec, params, None, "key"), spec, params, "key"), "key")
    with pytest.raises(ValueError):
        search.after(df, spec, params, search.cursor(search.after(df, spec, params, None, "key"), spec, params, "other"), "key")
