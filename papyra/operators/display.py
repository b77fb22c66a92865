"""How values are shown."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(size: Column) -> Column:
    """Like 1.4 MB; one decimal under 10 except for bytes, of two as near the even one; a dash for 0 and null."""
    power = F.when(size < 1 << 10, 0).when(size < 1 << 20, 1).when(size < 1 << 30, 2).otherwise(3)
    value = size / F.pow(F.lit(1024.0), power)
    unit = F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power)
    shown = F.when((value >= 10) | (power == 0), F.format_string("%.0f %s", F.bround(value, 0), unit)).otherwise(F.format_string("%.1f %s", F.bround(value, 1), unit))
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "—").otherwise(shown)


def relative_time(stamp: Column, as_of: datetime) -> Column:
    """Like 2 hr ago; minutes, hours and days each rounded from the unit before, half up. A dash for null, a date from 30 days on."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    rounded = lambda n, unit: F.floor((n + unit // 2) / unit)
    minutes = rounded(F.timestamp_diff("MILLISECOND", stamp, now), 60_000)
    hours = rounded(minutes, 60)
    days = rounded(hours, 24)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    shown = F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "min")).when(hours < 24, ago(hours, "hr"))
    shown = shown.when(days == 1, ago(days, "day")).when(days < 30, ago(days, "days")).otherwise(F.date_format(stamp, "dd MMM yyyy"))
    return F.when(stamp.isNull(), "—").otherwise(shown)


#: Marks around hits; no characters for interchange, so texts do not have them.
_BEGIN, _END = "\ufdd0", "\ufdd1"


def highlighted(text: Column, terms: list[str]) -> Column:
    """Array of text and whether it is one of the terms, in any case, in the text's order.

    Terms of one character do not count. Where several begin at one place the
    first of the list is the hit, of any length.
    """
    terms = [t for t in (t.strip().lower() for t in terms) if len(t) > 1]
    if not terms:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    either = "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms)
    parts = F.split(F.regexp_replace(text, f"(?iu)({either})", f"{_BEGIN}$1{_END}"), f"[{_BEGIN}{_END}]")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(p.alias("text"), F.lower(p).isin(*terms).alias("hit")))


def grouped_digits(number: int) -> str:
    """Groups of two digits before the last three, as in 12,34,567."""
    digits = str(abs(number))
    head, tail = digits[:-3], digits[-3:]
    pairs = [head[max(0, i - 2) : i] for i in range(len(head), 0, -2)][::-1]
    return "-" * (number < 0) + ",".join([*pairs, tail])
