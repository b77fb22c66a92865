"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target texts than in the corpus.

Everything is column expressions and SQL operations. N-grams are hashed into
buckets, so that whatever the corpus holds, its counts are one row for each
bucket: they are added up before the shuffle and the table of gains is small
enough to broadcast. A document's weight is the sum of the gains of its
n-grams; with Gumbel noise added, the highest scores are a draw without
replacement by these weights. Ranks come from one distributed sort: a row's
place in its partition and the number of rows in the partitions before.

Defined cases: a null text has no words and weighs 0; a null key counts as an
empty string in the noise and comes last among ties; each of repeated rows is a
document of its own; rows that are alike in everything but the text take any
order among themselves. Without target texts all counts of the target are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all of ASCII but digits and letters, which are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spark numbers the rows of a partition from its number times this.
PARTITION_ROWS = 1 << 33


@dataclass(frozen=True)
class Settings:
    """most: words of the longest n-gram. Of the documents of least_words at least, percent are drawn."""

    most: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def words(text: Column) -> Column:
    """Lower-cased words, in ASCII alone; none for null."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def ngrams(found: Column, most: int) -> Column:
    """All runs of 1 to most words, joined by spaces."""
    return F.concat(found, *[_runs(found, n) for n in range(2, most + 1)]) if most > 1 else found


def _runs(found: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda i: F.array_join(F.slice(found, i, n), " "))
    return F.when(F.size(found) >= n, runs).otherwise(F.array().cast("array<string>"))


def _exploded(df: DataFrame, text: str, settings: Settings, *kept: Column) -> DataFrame:
    """A row for each n-gram with its bucket, one with a null for a text without any; kept and n_words beside it."""
    rows = df.select(*kept, words(F.col(text)).alias("__words")).withColumn("n_words", F.size("__words").cast("long"))
    rows = rows.withColumn("__ngrams", ngrams(F.col("__words"), settings.most)).drop("__words")
    rows = rows.withColumn("__ngram", F.explode_outer("__ngrams")).drop("__ngrams")
    return rows.withColumn("bucket", F.crc32("__ngram") % settings.buckets).drop("__ngram")


def bucket_counts(df: DataFrame, text: str, settings: Settings) -> DataFrame:
    """bucket and n: how many n-grams of the texts it holds."""
    return _exploded(df, text, settings).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """bucket and gain, for every bucket: a thousandth's floor of the logarithm of its share in the target over that in the documents, each smoothed by one."""
    spark, zero = docs.sparkSession, F.lit(0).cast("long")
    own = bucket_counts(docs, text, settings).select("bucket", F.col("n").alias("s"), zero.alias("t"))
    wanted = bucket_counts(target, text, settings).select("bucket", zero.alias("s"), F.col("n").alias("t"))
    every = spark.range(0, settings.buckets, 1, 1).select(F.col("id").alias("bucket"), zero.alias("s"), zero.alias("t"))
    counts = checkpointed(own.unionByName(wanted).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    totals = counts.agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).first()
    ratio = (F.col("t").cast("double") + 1) * (totals["s"] + settings.buckets) / ((F.col("s").cast("double") + 1) * (totals["t"] + settings.buckets))
    return counts.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the seed and the key alone."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.ln(-F.ln((F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """__row, key, n_words, n_features, weight and score of each document. A task sums up its own documents before the shuffle."""
    rows = _exploded(docs, text, settings, F.monotonically_increasing_id().alias("__row"), F.col(key))
    rows = rows.join(F.broadcast(table), "bucket", "left")
    sums = rows.groupBy("__row", key, "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return sums.withColumn("score", F.col("weight") + noise(F.col(key), settings.seed))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """key, n_features, weight, score and rank of each document: 1, 2, 3 and so on for those that are drawn, by falling score and then key; else null."""
    rows = weighted(docs, gains(docs, target, text, settings), key, text, settings).withColumn("__short", F.col("n_words") < settings.least_words)
    order = ("__short", F.col("score").desc(), F.col(key).asc_nulls_last(), "__row")
    placed = checkpointed(rows.orderBy(*order).select(key, "n_features", "weight", "score", "__short", F.monotonically_increasing_id().alias("__at")))
    drawn = placed.where("NOT __short").count() * settings.percent // 100
    placed = placed.withColumn("__part", F.floor(F.col("__at") / PARTITION_ROWS))
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__at") % PARTITION_ROWS + 1
    ranked = placed.join(F.broadcast(before), "__part")
    return ranked.select(key, "n_features", "weight", "score", F.when(~F.col("__short") & (rank <= drawn), rank).alias("rank"))


def sql(settings: Settings = Settings()) -> str:
    """The same for DuckDB, for single words; the checksum's table is made by its rule and applied to each distinct word once."""
    buckets = settings.buckets
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, TRUE AS own FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, FALSE FROM benchmark
), found AS (
  SELECT r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts
), used AS (
  SELECT r, own, unnest(words) AS word FROM found
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(CAST(octet_length(encode(word)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), CAST(4294967295 AS BIGINT)), 4294967295) % {buckets} AS bucket
  FROM (SELECT DISTINCT word FROM used), crc
), counts AS (
  SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM used JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts)::DOUBLE + {buckets}) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts)::DOUBLE + {buckets})))) AS gain FROM counts
), weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM used JOIN hashed USING (word) JOIN gain USING (bucket) WHERE own GROUP BY r
), scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{settings.seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM found LEFT JOIN weights USING (r) WHERE own
), drawn AS (
  SELECT *, CASE WHEN n_features >= {settings.least_words} THEN row_number() OVER (PARTITION BY n_features >= {settings.least_words} ORDER BY score DESC, doc_id) END AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_features >= {settings.least_words}) * {settings.percent} // 100 THEN place END AS rank FROM drawn
"""
