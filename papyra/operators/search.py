"""Keyword search over any table: filters, weighted ranking, snippets, sort orders and pages.

A SearchSpec says which columns play which part; SearchParams what is asked.
Both become column expressions, so that a page of results is one plan: filters
that reach the scan, a projection, and a top-k instead of a full sort.
"""

from __future__ import annotations

import base64
import hmac
import json
import math
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone
from functools import reduce
from itertools import pairwise
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import vocabulary as v
from papyra.functions.text import collapsed

RECENT_DAYS, SNIPPET_BEFORE, SNIPPET_LENGTH, MOST_TERMS = 30, 130, 320, 8
SORTS = ("relevance", "newest", "oldest", "name", "priority")


@dataclass(frozen=True)
class SearchSpec:
    """Columns of a table by their part in search. text is where snippets come from, blob what all terms must be in besides name."""

    id: str
    weights: dict[str, int]
    blob: tuple[str, ...]
    filters: dict[str, str] = field(default_factory=dict)
    timestamp: str | None = None
    name: str | None = None
    text: str | None = None
    rank: str | None = None
    ranks: tuple[tuple[str, ...], ...] = (("High",), ("Medium",))
    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    projection: tuple[str, ...] = ()


@dataclass(frozen=True)
class SearchParams:
    q: str = ""
    filters: dict[str, list[str]] = field(default_factory=dict)
    date_range: str = "any"
    date_from: datetime | None = None
    date_to: datetime | None = None
    sort: str = "relevance"
    page: int = 1
    page_size: int = 20
    as_of: datetime | None = None

    @staticmethod
    def of(q: str | None = "", filters: dict | None = None, date_range: str | None = "any", sort: str | None = "relevance", page: int = 1, page_size: int = 20, **rest) -> SearchParams:
        """Of raw input: values repeated or separated by commas, names in any case. Pages that cannot be are refused."""
        if page < 1 or not 1 <= page_size <= 100:
            raise ValueError("page must be 1 at least, page_size between 1 and 100")
        given = {k: split_multi(x) for k, x in (filters or {}).items()}
        return SearchParams((q or "").strip(), {k: x for k, x in given.items() if x}, (date_range or "any").strip().lower(), sort=(sort or "relevance").strip().lower(), page=page, page_size=page_size, **rest)

    def applied_filters(self) -> dict:
        found = dict(self.filters)
        if self.date_range and self.date_range != "any":
            found["date_range"] = self.date_range
        found |= {k: x.isoformat() for k, x in (("date_from", self.date_from), ("date_to", self.date_to)) if x}
        return found

    @property
    def has_filters(self) -> bool:
        return bool(self.applied_filters())

    def as_query(self) -> str:
        """The search as a URL's query; what is as by default is left out."""
        given = {"q": self.q, **self.filters, "date_range": self.date_range if self.date_range != "any" else "", "sort": self.sort if self.sort != "relevance" else ""}
        given |= {"page": self.page if self.page > 1 else "", "page_size": self.page_size if self.page_size != 20 else ""}
        return urlencode({k: x for k, x in given.items() if x}, doseq=True)

    @staticmethod
    def of_query(query: str, kinds: tuple[str, ...]) -> SearchParams:
        """Of a URL's query with filters of these kinds; pages that cannot be are moved to the nearest that can."""
        given = parse_qs(query)
        first = lambda name, default: (given.get(name) or [default])[0]
        number = lambda name, default: int(x) if (x := first(name, "")).lstrip("-").isdigit() else default
        filters = {k: given[k] for k in kinds if k in given}
        return SearchParams.of(first("q", ""), filters, first("date_range", "any"), first("sort", "relevance"), max(1, number("page", 1)), min(100, max(1, number("page_size", 20))))

    def filtered_by(self, kind: str, values: list[str]) -> SearchParams:
        """With another choice of one kind, from the first page on."""
        filters = {k: x for k, x in {**self.filters, kind: values}.items() if x}
        return replace(self, filters=filters, page=1)

    def active(self, labels: dict[str, dict[str, str]]) -> list[tuple[str, str, str]]:
        """Kind, value and label of each filter that is on, the date range last."""
        chosen = [(k, x) for k, values in self.filters.items() for x in values]
        chosen += [("date_range", self.date_range)] * (self.date_range not in ("", "any"))
        return [(k, x, labels.get(k, {}).get(x, x)) for k, x in chosen]

    def applied_sort(self) -> str:
        if self.sort not in SORTS:
            return "relevance" if self.q.strip() else "newest"
        return "newest" if self.sort == "relevance" and not self.q.strip() else self.sort


def split_multi(values) -> list[str]:
    """Values, repeated or comma-separated, trimmed, each once."""
    values = [values] if isinstance(values, str) else list(values or [])
    return list(dict.fromkeys(p.strip() for x in values for p in x.split(",") if p.strip()))


def parse_terms(query: str | None) -> list[str]:
    """Words and quoted phrases in lower case, of two characters at least; the whole query if there is none."""
    asked = (query or "").strip().lower()
    terms = [t for t in (raw.strip('"').strip() for raw in re.findall(r'"[^"]+"|\S+', asked)) if len(t) >= 2]
    return (terms or [asked] * bool(asked))[:MOST_TERMS]


def shown_terms(query: str | None) -> list[str]:
    """Words and quoted phrases of a query as they are to be highlighted: their case as it is, all quotes gone, of two characters at least."""
    return [t for t in (raw.replace('"', "").strip() for raw in re.findall(r'"[^"]+"|\S+', query or "")) if len(t) > 1]


def _contains(column: Column, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(term)), F.lit(False))


def matches(spec: SearchSpec, terms: list[str]) -> Column | None:
    """Every term somewhere in the blob columns or the name."""
    if not terms:
        return None
    places = [F.col(c) for c in dict.fromkeys([*spec.blob, *([spec.name] if spec.name else [])])]
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [_contains(p, t) for p in places]) for t in terms])


def score(spec: SearchSpec, terms: list[str]) -> Column:
    """Sum of the weights of all columns that contain a term, over all terms."""
    hits = [F.when(_contains(F.col(c), t), w).otherwise(0) for t in terms for c, w in spec.weights.items()]
    return reduce(lambda a, b: a + b, hits).cast("double") if hits else F.lit(0.0)


def date_bounds(params: SearchParams) -> tuple[datetime | None, datetime | None]:
    """First and last instant allowed, both included, in UTC without a zone."""
    naive = lambda t: t.astimezone(timezone.utc).replace(tzinfo=None) if t and t.tzinfo else t
    now = naive(params.as_of) or datetime.now(timezone.utc).replace(tzinfo=None)
    starts, ends = [naive(params.date_from)], [naive(params.date_to)]
    days = {"week": 7, "recent": RECENT_DAYS}.get(params.date_range)
    if params.date_range == "today":
        starts.append(now.replace(hour=0, minute=0, second=0, microsecond=0))
    elif days:
        starts.append(now - timedelta(days=days))
    elif params.date_range == "older":
        ends.append(now - timedelta(days=RECENT_DAYS))
    return max((s for s in starts if s), default=None), min((e for e in ends if e), default=None)


def filter_conditions(spec: SearchSpec, params: SearchParams) -> dict[str, Column]:
    """One condition for each kind of filter that is asked for."""
    found = {}
    for kind, values in params.filters.items():
        if not values or kind not in spec.filters:
            continue
        if kind == "file_type":
            values = [x.upper() for x in values]
        if kind == "status":
            values = [s for s in map(v.status_of, values) if s]
        found[kind] = F.coalesce(F.col(spec.filters[kind]).isin(*values), F.lit(False)) if values else F.lit(False)
    return found


def date_condition(spec: SearchSpec, params: SearchParams) -> Column | None:
    start, end = date_bounds(params) if spec.timestamp else (None, None)
    stamp = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    parts = []
    if start:
        parts.append(F.col(spec.timestamp) >= stamp(start))
    if end:
        parts.append(F.col(spec.timestamp) <= stamp(end))
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(df: DataFrame, spec: SearchSpec, params: SearchParams) -> DataFrame:
    conditions = [*filter_conditions(spec, params).values(), date_condition(spec, params), matches(spec, parse_terms(params.q))]
    return reduce(lambda d, c: d.where(c), [c for c in conditions if c is not None], df)


def snippet(text: Column, terms: list[str]) -> Column:
    """Some 320 characters around the first term, in the query's order, that the text contains, cut at words."""
    start = F.lit(1)
    for t in reversed(terms):
        at = F.instr(F.lower(text), F.lit(t))
        start = F.when(at > 0, F.greatest(at - SNIPPET_BEFORE, F.lit(1))).otherwise(start)
    one = collapsed(F.substring(text, start, F.lit(SNIPPET_LENGTH)))
    space = F.instr(one, F.lit(" "))
    one = F.when((start > 1) & (space > 0) & (space <= 40), F.concat(F.lit("…"), F.substring(one, space + 1, F.lit(SNIPPET_LENGTH)))).otherwise(one)
    shut = F.when(F.length(one) >= SNIPPET_LENGTH, F.concat(F.regexp_replace(one, r" [^ ]*$", ""), F.lit("…"))).otherwise(one)
    return F.when(shut != "", shut)


def sort_keys(spec: SearchSpec, sort: str) -> list[tuple[Column, bool]]:
    """What results are sorted by, and whether falling; the id is last, so no two rows are equal."""
    key = F.col(spec.id)
    stamp = F.col(spec.timestamp) if spec.timestamp else key
    if sort == "newest":
        return [(stamp, True), (key, True)]
    if sort == "oldest":
        return [(stamp, False), (key, False)]
    if sort == "name" and spec.name:
        return [(F.lower(F.col(spec.name)), False), (key, False)]
    if sort == "priority" and spec.rank:
        rank = F.lit(len(spec.ranks))
        for i, values in reversed(list(enumerate(spec.ranks))):
            rank = F.when(F.col(spec.rank).isin(*values), i).otherwise(rank)
        return [(rank, False), (stamp, True), (key, True)]
    return [(F.col("score"), True), (stamp, True), (key, True)]


def search(df: DataFrame, spec: SearchSpec, params: SearchParams) -> DataFrame:
    """The page of results asked for, in order: the projection, score and snippet.

    A page beyond the last is empty. Ties end at the id, so pages never overlap.
    Snippets are cut before rows are sorted, so that no whole text leaves its task.
    """
    terms = parse_terms(params.q)
    kept = [*dict.fromkeys([spec.id, *spec.projection])]
    shown = [F.coalesce(v.one_of(F.col(spec.filters[k]), names), F.col(spec.filters[k])).alias(f"{k}_label") for k, names in spec.labels.items()]
    found = filtered(df, spec, params).withColumn("score", score(spec, terms))
    keys = sort_keys(spec, params.applied_sort())
    cut = [snippet(F.col(spec.text), terms).alias("snippet")] if spec.text else []
    rows = found.select(*kept, *shown, F.round("score", 1).alias("score"), *cut, *[c.alias(f"_key{i}") for i, (c, _) in enumerate(keys)])
    order = [F.col(f"_key{i}").desc() if falling else F.col(f"_key{i}").asc() for i, (_, falling) in enumerate(keys)]
    rows = rows.orderBy(*order).offset((params.page - 1) * params.page_size).limit(params.page_size)
    return rows.drop(*[f"_key{i}" for i in range(len(keys))])


def _typed(value) -> list:
    """A key's value with its kind, for JSON."""
    if isinstance(value, datetime):
        return ["t", value.isoformat()]
    return ["n" if value is None else "s" if isinstance(value, str) else "f" if isinstance(value, float) else "i", value]


def _literal(kind: str, value) -> Column:
    return F.lit(value.replace("T", " ")).cast("timestamp_ntz") if kind == "t" else F.lit(None if kind == "n" else value)


def _asked(params: SearchParams) -> str:
    return repr(replace(params, page=1, page_size=1))


def cursor(page: DataFrame, spec: SearchSpec, params: SearchParams, secret: str) -> str | None:
    """Where a page of after() ends: the sort keys of its last row, signed together with the search they belong to. None for an empty page."""
    names = [c for c in page.columns if c.startswith("_key")]
    rows = page.select(*names).tail(1)
    if not rows:
        return None
    body = json.dumps([_typed(rows[0][c]) for c in names])
    return base64.urlsafe_b64encode(f"{_signed(body, spec, params, secret)}{body}".encode()).decode()


def _signed(body: str, spec: SearchSpec, params: SearchParams, secret: str) -> str:
    return hmac.new(secret.encode(), f"{spec.id}\n{_asked(params)}\n{body}".encode(), "sha256").hexdigest()


def after(df: DataFrame, spec: SearchSpec, params: SearchParams, cursor: str | None, secret: str) -> DataFrame:
    """The page that follows a cursor, the first without one, in order and with its sort keys (_key0 and so on).

    The order's bound is a filter on the scan, so a page costs what the first one does however deep it lies.
    A cursor of another search, or one that was tampered with, is refused.
    """
    terms, keys = parse_terms(params.q), sort_keys(spec, params.applied_sort())
    rows = filtered(df, spec, params).withColumn("score", score(spec, terms))
    if cursor:
        raw = base64.urlsafe_b64decode(cursor.encode()).decode()
        sign, body = raw[:64], raw[64:]
        if not hmac.compare_digest(sign, _signed(body, spec, params, secret)):
            raise ValueError("not a cursor of this search")
        held = [(c, falling, _literal(*x)) for (c, falling), x in zip(keys, json.loads(body), strict=True)]
        # Nulls come last in falling and first in rising order, as Spark sorts.
        beyond, same = F.lit(False), F.lit(True)
        for c, falling, x in held:
            later = (c < x) | (c.isNull() & x.isNotNull()) if falling else (c > x) | (c.isNotNull() & x.isNull())
            beyond = beyond | (same & F.coalesce(later, F.lit(False)))
            same = same & c.eqNullSafe(x)
        first, falling, x = held[0]
        edge = F.coalesce(first <= x, F.lit(True)) if falling else F.coalesce(first >= x, x.isNull())
        rows = rows.where(edge).where(beyond)
    shown = [F.coalesce(v.one_of(F.col(spec.filters[k]), labels), F.col(spec.filters[k])).alias(f"{k}_label") for k, labels in spec.labels.items()]
    cut = [snippet(F.col(spec.text), terms).alias("snippet")] if spec.text else []
    rows = rows.select(*dict.fromkeys([spec.id, *spec.projection]), *shown, F.round("score", 1).alias("score"), *cut, *[c.alias(f"_key{i}") for i, (c, _) in enumerate(keys)])
    order = [F.col(f"_key{i}").desc() if falling else F.col(f"_key{i}").asc() for i, (_, falling) in enumerate(keys)]
    return rows.orderBy(*order).limit(params.page_size)


#: Rows that ranked() looks into first, times as many in each round, and rows beyond which one plan over all does the rest.
FIRST_ROWS, WIDENING, MOST_ROWS = 64, 4, 4096


def ranked(df: DataFrame, spec: SearchSpec, params: SearchParams) -> DataFrame:
    """The same page as search(), in order, from few texts: whatever the narrow columns say of a row bounds its score, as its text can add one weight for each term.

    Rows go by that bound; those on top are verified and scored by their texts, more and more of them, until
    no other row can come before the page's last. Snippets are cut for the page alone. What comes to the driver
    are sort keys of 4,096 rows at most; a page that needs more is left to search().
    """
    terms, wanted = parse_terms(params.q), params.page * params.page_size
    if not terms or not spec.text or wanted > MOST_ROWS:
        return search(df, spec, params)
    narrow = replace(spec, weights={c: w for c, w in spec.weights.items() if c != spec.text})
    bound = score(narrow, terms) + spec.weights.get(spec.text, 0) * len(terms)
    keys = sort_keys(spec, params.applied_sort())
    named = [c.alias(f"_key{i}") for i, (c, _) in enumerate(keys)]
    order = [F.col(f"_key{i}").desc() if falling else F.col(f"_key{i}").asc() for i, (_, falling) in enumerate(keys)]
    kept = filtered(df, spec, replace(params, q=""))
    hopeful = kept.withColumn("score", bound).select(F.col(spec.id).alias("_id"), *named).orderBy(*order)
    rows = FIRST_ROWS + wanted
    while True:
        head = hopeful.limit(rows + 1).collect()
        some = filtered(kept.where(F.col(spec.id).isin(*[r["_id"] for r in head[:rows]])), spec, replace(params, filters={}, date_range="any", date_from=None, date_to=None))
        sure = some.withColumn("score", score(spec, terms)).select(F.col(spec.id).alias("_id"), *named).orderBy(*order).limit(wanted).collect()
        if len(head) <= rows or len(sure) == wanted and _before(sure[-1], head[rows], keys):
            break
        rows *= WIDENING
        if rows > MOST_ROWS:
            return search(df, spec, params)
    ids = [r["_id"] for r in sure[wanted - params.page_size :]]
    return search(df.where(F.col(spec.id).isin(*ids)), spec, replace(params, page=1))


def _before(a, b, keys: list[tuple[Column, bool]]) -> bool:
    """Whether row a comes before row b by their keys; not said where one is null."""
    for i, (_, falling) in enumerate(keys):
        x, y = a[f"_key{i}"], b[f"_key{i}"]
        if x is None or y is None:
            return False
        if x != y:
            return (x > y) == falling
    return True


def total(df: DataFrame, spec: SearchSpec, params: SearchParams) -> DataFrame:
    return filtered(df, spec, params).agg(F.count("*").alias("total"))


@dataclass(frozen=True)
class Paging:
    total: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total / self.page_size)

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages

    @property
    def has_prev(self) -> bool:
        return self.total > 0 and self.page > 1

    def window(self) -> list[int | None]:
        """Page numbers to offer: all up to seven, else the first, the last and those around this one; None for a gap."""
        last = self.total_pages
        if last <= 7:
            return [*range(1, last + 1)]
        shown = sorted({1, last} | {n for n in (self.page - 1, self.page, self.page + 1) if 1 <= n <= last})
        after_gap = {b for a, b in pairwise(shown) if b > a + 1}
        return [x for n in shown for x in ([None, n] if n in after_gap else [n])]

    def showing(self) -> tuple[int, int]:
        return (0, 0) if not self.total else ((self.page - 1) * self.page_size + 1, min(self.page * self.page_size, self.total))
