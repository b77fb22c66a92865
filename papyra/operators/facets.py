"""Counts for filters and key figures, each in one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import vocabulary as v
from papyra.operators.search import SearchParams, SearchSpec, date_condition, filter_conditions, matches, parse_terms


def facets(df: DataFrame, spec: SearchSpec, params: SearchParams) -> DataFrame:
    """facet, value, label, count: rows by value under all filters but the facet's own.

    One scan: a row goes to a facet if at most that facet's condition fails.
    Nulls and empty values are left out. Most frequent first, then by value.
    """
    for condition in (date_condition(spec, params), matches(spec, parse_terms(params.q))):
        df = df if condition is None else df.where(condition)
    own = filter_conditions(spec, params)
    failing = sum((F.when(c, 0).otherwise(1) for c in own.values()), F.lit(0))
    entries = []
    for name, column in spec.filters.items():
        others = failing - F.when(own[name], 0).otherwise(1) if name in own else failing
        entries.append(F.when(others == 0, F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value"))))
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.facet", "e.value").where("value <> ''")
    counted = rows.groupBy("facet", "value").agg(F.count("*").alias("count"))
    label: Column = F.col("value")
    for name, names in spec.labels.items():
        label = F.when(F.col("facet") == name, F.coalesce(v.one_of(F.col("value"), names), F.col("value"))).otherwise(label)
    return counted.select("facet", "value", label.alias("label"), "count")


def displayed(counts: DataFrame, selected: dict[str, list[str]], canonical: dict[str, list[str]]) -> DataFrame:
    """Every value of the vocabularies by its place in a filter list: selected ones first, those without a row last."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(f, x, i, x in selected.get(f, [])) for f, xs in canonical.items() for i, x in enumerate(xs)], "facet string, value string, ord int, selected boolean")
    rows = known.join(counts.drop("label"), ["facet", "value"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return rows.orderBy("facet", F.col("selected").desc(), F.col("count") == 0, "ord")


def stats(df: DataFrame) -> DataFrame:
    """One row of key figures of a library; actions, if there are any, is an array column."""
    complete = F.col("status") == "analysis_complete"
    actions = F.coalesce(F.sum(F.when(complete, F.greatest(F.size("actions"), F.lit(0)))), F.lit(0)) if "actions" in df.columns else F.lit(0)
    found = df.agg(
        F.count("*").alias("total_documents"),
        F.count_if(complete).alias("complete"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(complete & (F.col("priority") == "High")).alias("high_priority"),
        F.count_distinct(F.when(~F.col("department").isin("", v.UNASSIGNED), F.col("department"))).alias("departments"),
        F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages"),
        actions.cast("long").alias("actions"),
    )
    return found.withColumn("in_progress", F.col("total_documents") - F.col("complete") - F.col("failed"))


def low_quality_ocr(used: Column, quality: Column, least: float = 70.0) -> Column:
    return F.coalesce(used & (quality < least), F.lit(False))


def in_progress(status: Column) -> Column:
    """Statuses from which a document goes on by itself."""
    return F.coalesce(status.isin("queued", "processing", "ocr_processing", "ai_analysis"), F.lit(False))
