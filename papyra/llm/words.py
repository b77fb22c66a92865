"""Words and word shingles as column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the runs without separators; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def shingle_hashes(array: Column, size: int) -> Column:
    """64-bit hash of each run of size elements; of all together if there are fewer, none if there are none.

    array is read once for each element, so give a column, not an expression.
    """
    count = F.size(array)
    runs = F.transform(F.sequence(F.lit(1), count - (size - 1)), lambda i: F.xxhash64(F.slice(array, i, size)))
    none = F.array().cast("array<bigint>")
    return F.when(count >= size, runs).when(count > 0, F.array(F.xxhash64(array))).otherwise(none)
