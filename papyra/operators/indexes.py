"""Indexes over documents: postings of trigrams for keywords, bitmaps of values for facets and figures.

Both are made of a batch's rows, each of which has a number of its own (ord), without shuffling a text, and
read by batch. A posting says which rows have a trigram in what is searched; a
search reads the postings of its terms' trigrams, intersects the rarest ones, and looks
into the texts of what is left. A bitmap says which of 32,768 rows have a value; counts under any filters are bits of intersections.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import vocabulary as v
from papyra.operators.search import SearchParams, SearchSpec
from papyra.plans.workers import small_batches

#: Trigrams that a search intersects; of each term at least one.
MOST_TRIGRAMS = 6
FACETS = ("department", "priority", "file_type", "status", "document_type")
NUMBERS = {"page_count": "page_count", "actions": "size(actions)"}


def trigrams(text: str) -> np.ndarray:
    """Each run of three code points as one number, once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def postings(rows: DataFrame, columns: Sequence[str] = ("search_blob",), number: str = "ord") -> DataFrame:
    """trigram, n and places (n numbers of rows, rising) of lower-cased columns; a row of each trigram for each batch of rows that a task has, tasks' rows by trigram."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, keys, at = batch.column(0).to_numpy(), [], []
            for column in batch.columns[1:]:
                for i, text in enumerate(column):
                    if (found := trigrams(text.as_py() or "")).size:
                        keys.append(found)
                        at.append(np.full(len(found), numbers[i]))
            if not keys:
                continue
            pairs = np.unique(np.stack([np.concatenate(keys), np.concatenate(at)], axis=1), axis=0) if len(batch.columns) > 2 else None
            key, place = (pairs[:, 0], pairs[:, 1]) if pairs is not None else (np.concatenate(keys), np.concatenate(at))
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(first[1:], len(key))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place))
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(ends - first), lists], names=["trigram", "n", "places"])

    low = [F.lower(F.col(c)).alias(f"_{c}") for c in columns]
    return rows.select(number, *low).mapInArrow(run, "trigram long, n long, places array<long>").sortWithinPartitions("trigram")


def candidates(index: DataFrame, terms: Sequence[str], *by: str) -> DataFrame | None:
    """by and place of rows that may have all terms: those with the rarest of their trigrams. None if no term has three characters, as any row may have them then.

    index has trigram, n, places and by, columns that tell batches apart.
    """
    wanted = [set(trigrams(t).tolist()) for t in terms if len(t) > 2]
    if not wanted:
        return None
    every = sorted(set().union(*wanted))
    few = index.where(F.col("trigram").isin(*every))
    frequency = {t: 0 for t in every} | {r["trigram"]: r["n"] for r in few.groupBy("trigram").agg(F.sum("n").alias("n")).collect()}
    chosen = {min(own, key=lambda t: (frequency[t], t)) for own in wanted}
    chosen |= set(sorted(every, key=lambda t: (frequency[t], t))[: max(0, MOST_TRIGRAMS - len(chosen))])
    rows = few.where(F.col("trigram").isin(*chosen)).select(*by, "trigram", F.explode("places").alias("place"))
    return rows.groupBy(*by, "place").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(chosen)).drop("n")


def _number(name: str, value: Column) -> Column:
    """The bits of a number that are set, as facet and value."""
    places = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(value, i) == 1)
    return F.coalesce(F.transform(places, lambda i: F.struct(F.lit(name).alias("facet"), i.cast("string").alias("value"))), F.array().cast("array<struct<facet:string,value:string>>"))


def bitmaps(rows: DataFrame, facets: Sequence[str] = FACETS, numbers: dict[str, str] = NUMBERS, number: str = "ord") -> DataFrame:
    """facet, value, bucket and bits of a table's rows; facet and value are empty for all rows. Of a number each bit that is set is a value."""
    singles = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets if f in rows.columns]
    singles.append(F.struct(F.lit("").alias("facet"), F.lit("").alias("value")))
    lists = [_number(n, F.greatest(F.expr(sql), F.lit(0)).cast("long")) for n, sql in numbers.items() if n in rows.columns]
    entries = rows.select(number, F.explode(F.concat(F.array(*singles), *lists)).alias("e")).select(number, "e.*").where("value IS NOT NULL")
    return entries.groupBy("facet", "value", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def _constructed(rows: DataFrame, by: Sequence[str], number: str = "ord") -> DataFrame:
    return rows.groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def _intersected(rows: DataFrame, masks: list[DataFrame], by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, by, bucket and bits: bits of rows under every mask (by, bucket, bits); buckets that a mask lacks are empty."""
    for mask in masks:
        pairs = rows.join(mask.withColumnRenamed("bits", "_mask"), [*by, "bucket"])
        either = pairs.select(*keys, *by, "bucket", F.explode(F.array("bits", "_mask")).alias("bits"))
        rows = either.groupBy(*keys, *by, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return rows


def _counted(rows: DataFrame, dead: DataFrame | None, by: Sequence[str], keys: Sequence[str], name: str = "count") -> DataFrame:
    """keys and the bits of rows that are not dead."""
    found = rows.select(*keys, F.bitmap_count("bits").alias("_n"))
    if dead is not None:
        found = found.unionByName(_intersected(rows, [dead], by, keys).select(*keys, (-F.bitmap_count("bits")).alias("_n")))
    return found.groupBy(*keys).agg(F.sum("_n").alias(name)).where(F.col(name) > 0)


def facets(index: DataFrame, spec: SearchSpec, params: SearchParams, by: Sequence[str] = ("batch",), gone: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """operators.facets.facets() from bitmaps alone: facet, value, label and count under all filters but the facet's own.

    index has by, facet, value, bucket and bits; gone (by, ord) rows that do not count; hits (by, ord) those that
    keywords and dates leave, None where there are none.
    """
    masks: dict[str, DataFrame] = {}
    for kind, values in params.filters.items():
        if not values or kind not in spec.filters:
            continue
        values = [x.upper() for x in values] if kind == "file_type" else [s for s in map(v.status_of, values) if s] if kind == "status" else values
        masks[kind] = index.where((F.col("facet") == kind) & F.col("value").isin(*values)).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = [_constructed(hits, by)] if hits is not None else []
    dead = _constructed(gone, by) if gone is not None else None
    rows = []
    for kind in spec.filters:
        own = index.where((F.col("facet") == kind) & (F.col("value") != "")).select("facet", "value", *by, "bucket", "bits")
        rows.append(_intersected(own, [*[m for k, m in masks.items() if k != kind], *both], by, ("facet", "value")))
    counted = _counted(reduce(DataFrame.unionByName, rows), dead, by, ("facet", "value"))
    label: Column = F.col("value")
    for name, names in spec.labels.items():
        label = F.when(F.col("facet") == name, F.coalesce(v.one_of(F.col("value"), names), F.col("value"))).otherwise(label)
    return counted.select("facet", "value", label.alias("label"), "count")


def stats(index: DataFrame, by: Sequence[str] = ("batch",), gone: DataFrame | None = None) -> DataFrame:
    """operators.facets.stats() from bitmaps alone."""
    dead = _constructed(gone, by) if gone is not None else None
    keys = ("facet", "value")
    complete = index.where("facet = 'status' AND value = 'analysis_complete'").select(*by, "bucket", "bits")
    plain = index.where("facet IN ('', 'status', 'department', 'page_count')").select(*keys, *by, "bucket", "bits")
    done = _intersected(index.where("facet = 'actions' OR (facet = 'priority' AND value = 'High')").select(*keys, *by, "bucket", "bits"), [complete], by, keys)
    counts = _counted(plain.unionByName(done), dead, by, keys)
    of = lambda condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col("count"))), F.lit(0)).cast("long")
    summed = lambda name: F.coalesce(F.sum(F.when(F.col("facet") == name, F.col("count") * F.pow(F.lit(2.0), F.col("value").try_cast("int")).cast("long"))), F.lit(0)).cast("long")
    found = counts.agg(
        of("facet = ''").alias("total_documents"), of("facet = 'status' AND value = 'analysis_complete'").alias("complete"), of("facet = 'status' AND value = 'failed'").alias("failed"),
        of("facet = 'priority'").alias("high_priority"), F.count_if((F.col("facet") == "department") & ~F.col("value").isin("", v.UNASSIGNED)).alias("departments"),
        summed("page_count").alias("pages"), summed("actions").alias("actions"),
    )
    return found.withColumn("in_progress", F.col("total_documents") - F.col("complete") - F.col("failed"))
