"""Document fingerprints: the k smallest distinct 64-bit hashes of a text's word shingles.

Such a sketch of a union of texts follows from their sketches (merge), and two
sketches give estimates of resemblance, containment and distinct shingles. With
under k shingles a sketch is the whole set and all answers are exact. All of it
is column expressions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import text_or_empty
from papyra.llm.words import shingle_hashes, words

K, SHINGLE = 128, 5
#: Documents in a bucket of neighbours, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS = 1000, 50_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, sketch: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text column; null texts and texts without words have an empty one."""
    split = f"__{sketch}_words"
    return df.withColumn(split, words(F.col(text))).withColumn(sketch, bottom_k(shingle_hashes(F.col(split), size), k)).drop(split)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what a and b are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group. Each task keeps k hashes of a group at most, before and after the shuffle, however large the group."""
    each = df.select(*keys, F.explode(sketch).alias("__hash")).distinct()
    least = each.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__hash"))).where(F.col("__n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) over the share of the hash range up to the k-th smallest."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(2.0**-64)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits a hash, in the sketch's order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _constant(values: list[int]) -> Column:
    """values as one constant, not an expression for each: it is read when the plan is optimised."""
    return F.from_json(F.lit(f"[{','.join(map(str, values))}]"), "array<bigint>")


def _at_most(bounds: Column, count: int, key: Column) -> Column:
    """How many of the sorted bounds are at most key, by binary search."""
    steps = [1 << i for i in range(count.bit_length() - 1, -1, -1)] or [0]
    tried = lambda found, step: F.coalesce(F.get(bounds, found + step - 1) <= key, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, step: F.when(tried(found, step), found + step).otherwise(found))


def _in_buckets(df: DataFrame, buckets: int, tie: str) -> tuple[DataFrame, bool]:
    """df, which has a __key, with the __bucket that the key is in, and the __part of it by the hash of tie; and whether a bucket has parts.

    A bound that is several quantiles at once is a key of many rows: it has a
    bucket of its own, of as many parts.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = Counter(df.agg(F.percentile_approx("__key", shares, max(10_000, 10 * buckets))).first()[0] or () if shares else ())
    bounds = sorted({*cuts, *(c + 1 for c, n in cuts.items() if n > 1 and c < MOST)})
    parts = [1] * (len(bounds) + 1)
    for c, n in cuts.items():
        parts[bisect_right(bounds, c)] = n
    df = df.withColumn("__bucket", _at_most(_constant(bounds), len(bounds), F.col("__key")))
    if max(parts) == 1:
        return df.withColumn("__part", F.lit(0)), False
    own = F.get(_constant(parts), F.col("__bucket"))
    share = F.xxhash64(tie) / 2.0**64 + 0.5
    return df.withColumn("__part", F.when(own > 1, F.least(F.floor(share * own), own - 1)).otherwise(0).cast("int")), True


def with_next(df: DataFrame, key: str, columns: list[str], tie: str, prepared: Callable[[DataFrame], DataFrame] = lambda df: df, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """prepared(df) with next_<column>: the values in the row that follows by ascending key, after the last row in the first.

    Rows go to buckets of neighbouring keys, cut at quantiles, in one shuffle;
    each bucket also gets a copy of the row that follows its last. What comes
    to the driver is a bound and a first key for each of MOST_BUCKETS buckets
    or so at most. Null keys come first, equal keys are ordered by a hash of
    tie, then by tie; so a key of many rows has several buckets. Only rows that
    are equal in both stay together. prepared adds columns to each row alone.
    """
    spark = df.sparkSession
    df = df.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(LEAST)))
    df, parts = _in_buckets(df, min(MOST_BUCKETS, max(1, df.count() // bucket_rows)), tie)
    heads = sorted(tuple(r) for r in df.groupBy("__bucket", "__part").agg(F.min("__key")).collect())
    follow = [(*heads[i - 1][:2], head[2], head[1]) for i, head in enumerate(heads)]
    following = spark.createDataFrame(follow, "__at int, __at_part int, __head long, __head_part int")
    own = df.columns
    heading = (F.col("__key") == F.col("__head")) & ((F.col("__part") == F.col("__head_part")) if parts else F.lit(True))
    copies = df.join(F.broadcast(following), heading).groupBy("__at", "__at_part").agg(F.min_by(F.struct(*own), F.struct(F.xxhash64(tie), F.col(tie))).alias("__row"))
    places = {"__bucket": F.col("__at"), "__part": F.col("__at_part")}
    copies = copies.select(*[places.get(c, F.col("__row")[c]).alias(c) for c in own], F.lit(1).alias("__copy"))
    both = prepared(df.withColumn("__copy", F.lit(0))).unionByName(prepared(copies)).withColumn("__tie", F.xxhash64(tie))
    order = Window.partitionBy("__bucket", "__part").orderBy("__copy", "__key", "__tie", tie)
    both = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return both.where(F.col("__copy") == 0).drop("__key", "__bucket", "__part", "__copy", "__tie")


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """One row per row of df: key, text, sketch (array of longs), fingerprint.

    Null texts count as empty: an empty sketch. Repeated rows stay; an empty
    table gives an empty one; further columns are not read. Nothing is shuffled.
    """
    return with_sketch(df.select(key, text_or_empty(text).alias("text")), "text", "sketch", k, size).withColumn("fingerprint", as_text(F.col("sketch")))


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, size: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the beginning of the next document.

    One row per row of df: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A single document follows itself;
    null texts count as empty, null keys come first, rows with equal keys follow
    each other as with_next() says. Each text is sketched once, as is each edited one.
    """
    docs = df.select(key, text_or_empty(text).alias("text"))
    docs = with_next(docs, key, ["text", "sketch"], "text", lambda d: with_sketch(d, "text", "sketch", k, size), bucket_rows)
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("__quarter", F.expr("CAST(n_chars DIV 4 AS INT)"))
    docs = docs.withColumn("edited", F.concat(F.expr("left(text, CAST(n_chars AS INT) - __quarter)"), F.expr("left(next_text, __quarter)")))
    docs = with_sketch(docs, "edited", "edited_sketch", k, size)
    return docs.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
