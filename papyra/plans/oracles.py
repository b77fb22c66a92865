"""The registered queries in SQL for DuckDB."""

from __future__ import annotations

import re

from papyra.functions import vocabulary as v
from papyra.operators.rules import NO_TEXT
from papyra.operators.search import parse_terms
from papyra.plans.queries import CASES, REPLY, UNREAD
from papyra.plans.store_queries import SEARCHES
from papyra.sources import library as lib
from papyra.streaming.store import CHUNK

LIB = lib.duckdb_library()
AS_OF = "TIMESTAMP '2024-03-30 12:00:00'"
FIELDS = ("filename", "document_type", "department", "extracted_text")
WEIGHTS = lib.LIBRARY.weights


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def hit(column: str, term: str) -> str:
    return f"contains(lower(coalesce({column}, '')), {q(term)})"


def match(*terms: str, columns=("search_blob", "filename")) -> str:
    return " AND ".join("(" + " OR ".join(hit(c, t) for c in columns) + ")" for t in terms)


def score(*terms: str, weights=WEIGHTS) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {hit(c, t)} THEN {w} ELSE 0 END" for t in terms for c, w in weights.items()) + " AS DOUBLE)"


def page(columns: str, terms: tuple[str, ...], table: str = f"({LIB})", by: str = "score DESC, uploaded_at DESC, id DESC", limit: int = 20, offset: int = 0, where: str = "TRUE", weights=WEIGHTS, blob=("search_blob", "filename")) -> str:
    rank = score(*terms, weights=weights) if terms else "0.0::DOUBLE"
    return f"SELECT {columns} FROM (SELECT *, {rank} AS score FROM {table} WHERE {match(*terms, columns=blob) if terms else 'TRUE'} AND {where} ORDER BY {by} LIMIT {limit} OFFSET {offset})"


def ids(where: str) -> str:
    return f"SELECT id FROM ({LIB}) WHERE {where}"


def snippet(text: str, terms: tuple[str, ...]) -> str:
    at = [f"instr(lower({text}), {q(t)})" for t in terms]
    start = "CASE " + " ".join(f"WHEN {a} > 0 THEN greatest({a} - 130, 1)" for a in at) + " ELSE 1 END"
    return f"""(SELECT CASE WHEN length(b) >= 320 THEN regexp_replace(b, ' [^ ]*$', '') || '…' ELSE nullif(b, '') END FROM (
      SELECT CASE WHEN s > 1 AND instr(a, ' ') BETWEEN 1 AND 40 THEN '…' || substr(a, instr(a, ' ') + 1) ELSE a END AS b FROM (
      SELECT s, trim(regexp_replace(substr({text}, s, 320), '\\s+', ' ', 'g')) AS a FROM (SELECT {start} AS s))))"""


def facet(source: str, filters: dict[str, str], columns: dict[str, str], where: str = "TRUE", labels: bool = False) -> str:
    parts = []
    for name, column in columns.items():
        others = [c for k, c in filters.items() if k != name] or ["TRUE"]
        label = "CASE " + column + " " + " ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in v.STATUS_LABELS.items()) + f" ELSE {column} END" if labels and name == "status" else column
        parts.append(f"SELECT {q(name)} AS facet, {column} AS value, {label} AS label, count(*) AS count FROM {source} WHERE {where} AND {' AND '.join(others)} AND {column} <> '' GROUP BY ALL")
    return " UNION ALL ".join(parts)


KINDS = lib.LIBRARY.filters
ORDERED = {"orders": lib.ORDERS.filters, "events": lib.EVENTS.filters}

# ---------------------------------------------------------------- text
#: Column of tagged text.
TAGS = "tags"
TOKEN = r"[A-Za-z\x{0d00}-\x{0d7f}][A-Za-z0-9\x{0d00}-\x{0d7f}\-]{2,}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ratio(x: str) -> str:
    letters = f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"
    return f"CASE WHEN {letters} > 0 THEN length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) / {letters} ELSE 0.0 END"


def reflow(x: str) -> str:
    """The text after the last line end is the open line; a line end at the very end means there is none."""
    last = "regexp_extract(a, '[^\\n]*$')"
    joins = f"x <> '' AND {last} <> '' AND length({last}) >= 45 AND NOT regexp_matches({last}, '[.!?:;]$') AND {ratio(last)} <= 0.7"
    step = f"CASE WHEN {joins} THEN a || ' ' || x WHEN x = '' THEN CASE WHEN a = '' OR ends_with(a, chr(10)) THEN a ELSE a || chr(10) END WHEN a = '' OR ends_with(a, chr(10)) THEN a || x ELSE a || chr(10) || x END"
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {strip('l')})"
    return f"rtrim(list_reduce(list_prepend('', {lines}), lambda a, x: {step}), chr(10))"


def sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: length(s) > 25)"


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{TOKEN}'), lambda w: lower(w)), lambda w: w NOT IN {names(v.STOP_WORDS)})"


def tag(x: str) -> str:
    return f"regexp_replace(lower({x}), '([a-z0-9]+)', chr(1) || '\\1' || chr(2), 'g')"


def mark(phrase: str) -> str:
    return q(re.sub("([a-z0-9]+)", "\x01\\1\x02", phrase.lower()))


def count(tags: str, phrase: str) -> str:
    times = lambda m: f"((length({tags}) - length(replace({tags}, {m}, ''))) // length({m}))"
    m = mark(phrase)
    return times(m) if phrase[-1].isalnum() else f"({times(m)} - {times(f'({m} || chr(1))')})"


def has(tags: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({tags}, {mark(p)})" for p in phrases) + ")"


def trim_to(x: str, limit: int) -> str:
    one = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({one}) > {limit} THEN rtrim(left({one}, {limit - 1})) || '…' ELSE {one} END"


def date(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {q(p)}), '')" for p in v.DATE_PATTERNS) + ")"


def dated(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in v.DATE_PATTERNS) + ")"


def title_cased(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')"


def filename_title(x: str) -> str:
    stem = f"regexp_replace(regexp_replace({x}, '\\.[A-Za-z0-9]+$', ''), '[_\\-]+', ' ', 'g')"
    return title_cased(f"trim(regexp_replace({stem}, '\\s+', ' ', 'g'))")


def language(x: str) -> str:
    own, latin = f"length(regexp_replace(left({x}, 20000), '[^\\x{{0d00}}-\\x{{0d7f}}]', '', 'g'))", f"length(regexp_replace(left({x}, 20000), '[^A-Za-z]', '', 'g'))"
    return f"CASE WHEN {own} + {latin} = 0 THEN 'Unknown' WHEN {own} / ({own} + {latin}) > 0.75 THEN 'Malayalam' WHEN {own} / ({own} + {latin}) > 0.08 THEN 'Bilingual (EN/ML)' ELSE 'English' END"


def per_document(**columns: str) -> str:
    return "SELECT doc_id, " + ", ".join(f"{x} AS {n}" for n, x in columns.items()) + " FROM documents"


def per_entry(**columns: str) -> str:
    return "SELECT id, " + ", ".join(f"{x} AS {n}" for n, x in columns.items()) + f" FROM ({LIB})"


# ---------------------------------------------------------------- rules
def best(keywords, long: int, own: int = 0) -> str:
    rows = []
    for place, (name, words) in enumerate(keywords.items()):
        total = " + ".join(f"{count('tags', w)} * {2 if len(w) > long else 1}" for w in words)
        rows.append(f"{{'score': {total}{f' + CASE WHEN {has(TAGS, [name.lower()])} THEN {own} ELSE 0 END' if own else ''}, 'place': {-place}, 'name': {q(name)}}}")
    return f"list_sort(list_filter([{', '.join(rows)}], lambda e: e.score > 0), 'DESC')"


BASE = f"""
WITH lib AS ({LIB}),
bodies AS MATERIALIZED (SELECT id, filename, {strip('extracted_text')} AS raw, {reflow(strip('extracted_text'))} AS body FROM lib),
tagged AS MATERIALIZED (SELECT *, {tag("filename || chr(10) || body")} AS tags FROM bodies),
depts AS MATERIALIZED (SELECT *, {best(v.DEPARTMENT_KEYWORDS, 12)} AS ranked FROM tagged),
judged AS MATERIALIZED (SELECT *, coalesce(ranked[1].name, 'Unassigned') AS department, coalesce(ranked[1].score, 0) AS top,
  {' + '.join(count('tags', s) for s in v.HIGH_SIGNALS)} AS high, {' + '.join(count('tags', s) for s in v.MEDIUM_SIGNALS)} AS medium, {dated('body')} AS dated FROM depts),
prior AS MATERIALIZED (SELECT *, CASE WHEN high >= 3 OR (high >= 1 AND department = 'Safety') OR (high >= 2 AND dated) THEN 'High' WHEN high >= 1 OR medium >= 2 OR dated THEN 'Medium' ELSE 'Low' END AS priority FROM judged),
lines AS MATERIALIZED (SELECT id, unnest({sentences('body')}) AS s, generate_subscripts({sentences('body')}, 1) AS n FROM bodies),
said AS MATERIALIZED (SELECT *, {tag('s')} AS st FROM lines)"""


def owner() -> str:
    named = " ".join(f"WHEN contains(lower(s), {q(d.lower())}) THEN {q(d)}" for d in v.DEPARTMENTS)
    hinted = " ".join(f"WHEN {has('st', w[:5])} THEN {q(d)}" for d, w in v.DEPARTMENT_KEYWORDS.items())
    return f"CASE {named} {hinted} WHEN department <> 'Unassigned' THEN department ELSE '' END"


def listed(expression: str, where: str, most: int, name: str, join: str = "") -> str:
    return f"""{BASE}, kept AS (SELECT id, n, {expression} AS x FROM said {join} WHERE {where} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) <= {most})
SELECT id, coalesce((SELECT string_agg(x, '|' ORDER BY n) FROM kept WHERE kept.id = lib.id), '') AS {name} FROM lib"""


def cased(x: str) -> str:
    """Titles of capitals in title case, for words of ASCII."""
    word = lambda w: f"regexp_extract({w}, '^[^\\p{{L}}]*') || upper(left(regexp_replace({w}, '^[^\\p{{L}}]*', ''), 1)) || lower(substr(regexp_replace({w}, '^[^\\p{{L}}]*', ''), 2))"
    bare = "regexp_replace(w, '^[.,:;()\\[\\]]+|[.,:;()\\[\\]]+$', '', 'g')"
    small = f"CASE WHEN upper({bare}) IN {names(v.ACRONYMS)} OR (regexp_full_match({bare}, '\\p{{Lu}}+') AND NOT regexp_matches({bare}, '[AEIOU]')) THEN w WHEN i > 1 AND lower(w) IN {names(v.MINOR_WORDS)} THEN lower(w) WHEN regexp_full_match(regexp_extract(w, '^[^\\p{{L}}]*'), '[0-9]+') THEN lower(w) ELSE {word('w')} END"
    return f"CASE WHEN {ratio(x)} < 0.7 THEN {x} ELSE array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda w, i: {small}), ' ') END"


TITLE = f"""{BASE}, cut AS (SELECT id, filename, list_transform(list_slice(string_split(raw, chr(10)), 1, 30), lambda l: regexp_replace(l, '^[ \\t\\-—_*#]+|[ \\t\\-—_*#]+$', '', 'g')) AS ls FROM bodies),
pick AS (SELECT id, filename, coalesce(
  list_filter(list_transform(list_filter(ls, lambda l: regexp_matches(l, '(?i)^(?:subject:|sub:|subject -)')), lambda l: regexp_replace(regexp_replace(l, '(?i)^(?:subject:|sub:|subject -)', ''), '^[ \\-–—]+|[ \\-–—]+$', '', 'g')), lambda l: length(l) >= 8)[1],
  list_filter(list_slice(ls, 1, 8), lambda l: length(l) BETWEEN 8 AND 140 AND NOT starts_with(lower(l), 'page '))[1], '') AS found FROM cut)
SELECT id, coalesce(nullif({cased('found')}, ''), {filename_title('filename')}) AS title FROM pick"""

SUMMARY = f"""{BASE},
words AS (SELECT id, unnest({tokens('body')}) AS w, generate_subscripts({tokens('body')}, 1) AS p FROM bodies),
ranked_words AS (SELECT id, w FROM words GROUP BY id, w QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(p)) <= 40),
calm AS (SELECT *, {ratio('s')} <= 0.6 AS ok, max(CASE WHEN {ratio('s')} <= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS any_ok FROM said),
cand AS MATERIALIZED (SELECT id, n, s, st, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS i FROM calm WHERE ok OR any_ok = 0 QUALIFY i < 400),
own AS (SELECT id, i, unnest(list_distinct({tokens('s')})) AS w FROM cand),
shared AS (SELECT own.id, i, count(*) AS k FROM own JOIN ranked_words USING (id, w) GROUP BY ALL),
worth AS (SELECT cand.*, coalesce(k, 0) + CASE WHEN {has('st', v.ACTION_SIGNALS)} THEN 2 ELSE 0 END + CASE WHEN i < 5 THEN 1.5 ELSE 0 END - CASE WHEN length(s) > 320 THEN 0.5 ELSE 0 END AS worth FROM cand LEFT JOIN shared USING (id, i)),
chosen AS (SELECT id, i, s FROM worth QUALIFY row_number() OVER (PARTITION BY id ORDER BY worth DESC, i) <= 5),
joined AS (SELECT id, string_agg(s, ' ' ORDER BY i) AS summary, list(s ORDER BY i) AS parts FROM chosen GROUP BY id)
SELECT id, coalesce(nullif({trim_to("coalesce(summary, '')", 900)}, ''), left(body, 400)) AS summary,
  array_to_string(list_transform(list_slice(coalesce(parts, []), 1, 4), lambda x: {trim_to('x', 220)}), '|') AS key_points FROM bodies LEFT JOIN joined USING (id)"""

KEYWORDS = f"""{BASE},
words AS (SELECT id, unnest({tokens('body')}) AS w, generate_subscripts({tokens('body')}, 1) AS p FROM bodies),
ranked_words AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(p)) AS k FROM words GROUP BY id, w QUALIFY k <= 12)
SELECT id, coalesce((SELECT string_agg(w, '|' ORDER BY k) FROM ranked_words r WHERE r.id = lib.id), '') AS keywords FROM lib"""

DEADLINES = f"""{BASE}, d AS (SELECT id, n, s, {date('s')} AS date FROM said),
first AS (SELECT * FROM d WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, lower(date) ORDER BY n) = 1),
kept AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) <= 6)
SELECT id, coalesce((SELECT string_agg(date || '~' || {trim_to('s', 200)}, '|' ORDER BY n) FROM kept WHERE kept.id = lib.id), '') AS deadlines FROM lib"""

ACTION = f"{trim_to('s', 260)} || '~' || ({owner()}) || '~' || coalesce({date('s')}, '') || '~' || CASE WHEN {has('st', v.HIGH_SIGNALS)} THEN 'High' ELSE priority END"


def alias(table: dict[str, str], known, fallback: str) -> str:
    x = "lower(trim(c))"
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(y)}" for k, y in {**table, **{n.lower(): n for n in known}}.items()) + f" ELSE {fallback} END"


CASED = f"(SELECT doc_id, {CASES} AS c FROM documents)"
PARTS = lib.PARTS.weights
PRIORITY = "CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, uploaded_at DESC, id DESC"
SAFE = "regexp_replace('b (1) é&' || filename, '[^A-Za-z0-9._\\- ]+', '_', 'g')".replace("'b (1) é&' || filename", "list_last(string_split('../a/b (1) é&' || filename, '/'))")
WRAPPED = strip("regexp_replace(text, '([^\\n]{50}[^ \\n]*) ', '\\1' || chr(10), 'g')")
CLEANED = "chr(32) || chr(9) || replace(text, '.', '.' || chr(10) || chr(10) || chr(10) || ' ' || chr(9) || ' ')"
SIZE = "(n_chars * n_chars)"
LABEL = "CASE status " + " ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in v.STATUS_LABELS.items()) + " ELSE status END"

# ---------------------------------------------------------------- analysed rows
ACTIONS = f"""{BASE}, kept AS (SELECT id, n, {trim_to('s', 260)} AS x FROM said WHERE {has('st', v.ACTION_SIGNALS)} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) <= 8)
SELECT id, coalesce(string_agg(x, ' ' ORDER BY n), '') AS action_texts, count(x) AS action_count FROM lib LEFT JOIN kept USING (id) GROUP BY id"""
DEADLINE_COUNT = DEADLINES[: DEADLINES.index("SELECT id, coalesce(")] + "SELECT id, count(date) AS deadline_count FROM lib LEFT JOIN kept USING (id) GROUP BY id"
TYPE = f"{BASE} SELECT id, coalesce(({best(v.DOCUMENT_TYPE_KEYWORDS, 14, 3)})[1].name, 'Other') AS document_type FROM tagged"
SECONDARY = f"{BASE} SELECT id, array_to_string(list_transform(list_filter(list_slice(ranked, 2, 4), lambda d: d.score >= greatest(2, top * 0.35)), lambda d: d.name), ' ') AS secondary FROM judged"
ANALYSED = f"""SELECT l.*, title, document_type, department, priority, summary, action_count, deadline_count,
  CASE WHEN keywords = '' THEN '[]' ELSE '["' || replace(keywords, '|', '", "') || '"]' END AS keywords_text, {language('extracted_text')} AS language,
  lower(concat_ws(' ' || chr(10), filename, nullif(title, ''), document_type, department, nullif(secondary, ''), priority, nullif(summary, ''), nullif(replace(keywords, '|', ' '), ''), nullif(key_points, ''), nullif(action_texts, ''), {language('extracted_text')}, nullif(extracted_text, ''))) AS search_blob
FROM (SELECT * EXCLUDE (document_type, department, priority, search_blob) FROM ({LIB})) l JOIN ({TITLE}) USING (id) JOIN ({TYPE}) USING (id) JOIN ({SECONDARY}) USING (id) JOIN ({BASE} SELECT id, department, priority FROM prior) p USING (id)
JOIN ({SUMMARY.replace("'|') AS key_points", "' ') AS key_points")}) USING (id) JOIN ({KEYWORDS}) USING (id) JOIN ({ACTIONS}) USING (id) JOIN ({DEADLINE_COUNT}) USING (id)"""
SEARCH_ANALYSED = f"""WITH a AS MATERIALIZED ({ANALYSED}), hits AS MATERIALIZED (SELECT *, {score('inspection', 'safety', weights=lib.ANALYSED.weights)} AS score FROM a WHERE {match('inspection', 'safety')} AND priority IN ('High', 'Medium'))
SELECT id, filename, title, file_type, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS file_ext, strlen(extracted_text) AS size_bytes, uploaded_at, uploaded_at AS processed_at, status, 'Analysed with rule engine' AS status_detail, page_count,
  len(list_filter(regexp_split_to_array(extracted_text, '\\s+'), lambda w: w <> '')) AS word_count, language, ocr_used, ocr_quality, document_type, department, priority, summary, keywords_text AS keywords, action_count, deadline_count, 'rule-based' AS analysis_engine,
  {LABEL} AS status_label, score, {snippet('extracted_text', ('inspection', 'safety'))} AS snippet, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY score DESC, uploaded_at DESC, id DESC LIMIT 100"""
ASKED = "(id % 6 IN (0, 1) AND id % 11 <> 0)"
NOTE = "'AI analysis unavailable (' || {} || '); used rule-based analysis.'"
FALLBACK = f"""SELECT l.id, CASE WHEN {ASKED} THEN l.department WHEN id % 11 = 0 THEN 'Unassigned' ELSE p.department END AS department,
  CASE WHEN {ASKED} THEN CASE id % 4 WHEN 1 THEN 'High' WHEN 3 THEN 'Low' ELSE 'Medium' END WHEN id % 11 = 0 THEN 'Medium' ELSE p.priority END AS priority,
  CASE WHEN {ASKED} THEN 'Review of ' || filename WHEN id % 11 = 0 THEN {filename_title('filename')} ELSE title END AS title,
  CASE WHEN {ASKED} THEN 'model' ELSE 'rule-based' END AS analysis_engine,
  CASE WHEN id % 11 = 0 THEN '' WHEN id % 6 = 2 THEN {NOTE.format("'TimeoutError'")} WHEN id % 6 = 3 THEN {NOTE.format("'unreadable reply'")} ELSE '' END AS analysis_error
FROM ({LIB}) l JOIN ({BASE} SELECT id, department, priority FROM prior) p USING (id) JOIN ({TITLE}) USING (id)"""


# ---------------------------------------------------------------- files
def clean(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def seen(x: str) -> tuple[str, str]:
    """Text and confidence of the recogniser."""
    words = f"list_filter(list_transform(string_split({x}, ' '), lambda w: {{'w': {strip('w')}, 'c': CASE WHEN length(w) = 1 THEN -1.0::DOUBLE ELSE least(100.0, 10.0 * length(w))::DOUBLE END}}), lambda e: e.w <> '')"
    return clean(f"array_to_string(list_transform({words}, lambda e: e.w), ' ')"), f"round_even(list_avg(list_transform(list_filter({words}, lambda e: e.c >= 0), lambda e: e.c)), 1)"


def one(n: int, text: str, ocr: str = "FALSE", sure: str = "NULL") -> str:
    return f"{{'n': {n}, 'x': {text}, 'o': {ocr}, 'c': CAST({sure} AS DOUBLE)}}"


SCAN, IMAGE = seen("text"), seen("text")
BARE = "regexp_replace({}, '[\\x00-\\x08\\x0a-\\x1f]', '', 'g')"
DOCX = clean(f"array_to_string(list_append(list_filter(list_transform(string_split(text, chr(10)), lambda l: {BARE.format('l')}), lambda l: {strip('l')} <> ''), 'a | ' || coalesce(nullif({BARE.format(strip('left(text, 20)'))}, ''), 'b')), chr(10))")
FILES = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, (['txt', 'docx', 'pdf', 'png', 'exe', 'csv', 'log', 'pdf'])[CAST(doc_id % 8 + 1 AS INT)] AS kind FROM documents),
gated AS (SELECT *, CASE WHEN kind = 'exe' THEN 'unsupported type' WHEN doc_id % 50 = 9 OR (text = '' AND kind NOT IN ('docx', 'pdf') AND doc_id % 50 <> 8) THEN 'empty file' WHEN doc_id % 50 = 8 THEN 'over 40 MB' END AS reason FROM docs),
parts AS MATERIALIZED (SELECT *, {clean('text')} AS first, {SCAN[0]} AS scan, {SCAN[1]} AS scan_sure, {IMAGE[0]} AS image, {IMAGE[1]} AS image_sure, {DOCX} AS docx, {clean('text')} AS plain FROM gated),
read AS MATERIALIZED (SELECT *, CASE WHEN reason IS NOT NULL THEN [] WHEN kind = 'docx' THEN [{one(1, 'docx')}] WHEN kind = 'png' THEN [{one(1, 'image', 'TRUE', 'image_sure')}]
  WHEN kind = 'pdf' THEN [CASE WHEN first = '' THEN {one(1, "'x'", 'TRUE', '50')} ELSE {one(1, 'first')} END, CASE WHEN length(scan) > 2 THEN {one(2, 'scan', 'TRUE', 'scan_sure')} ELSE {one(2, "'p2'")} END, {one(3, "'page three'")}]
  WHEN plain = '' THEN [] ELSE [{one(1, 'plain')}] END AS pages FROM parts),
whole AS (SELECT *, {clean("array_to_string(list_transform(list_filter(pages, lambda p: p.x <> ''), lambda p: p.x), chr(10) || chr(10))")} AS body, len(list_filter(pages, lambda p: p.o)) AS scanned FROM read)"""
WORDS = "len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))"
EXTRACT = f"""{FILES} SELECT 'Note of ' || doc_id || '.' || CASE WHEN doc_id % 3 = 0 THEN upper(kind) ELSE kind END AS filename, CASE kind WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'DOCX' WHEN 'png' THEN 'IMAGE' ELSE 'TXT' END AS file_type, kind AS file_ext,
  CAST(CASE WHEN reason IS NOT NULL THEN NULL WHEN kind = 'docx' THEN CASE WHEN {WORDS} > 0 THEN greatest(1, round_even({WORDS} / 500.0, 0)) END WHEN kind = 'pdf' THEN 3 ELSE 1 END AS INT) AS page_count,
  scanned > 0 AS ocr_used, round(list_avg(list_transform(list_filter(pages, lambda p: p.o), lambda p: p.c)), 1) AS ocr_quality,
  CASE WHEN reason IS NOT NULL THEN NULL WHEN kind = 'docx' THEN 'docx' WHEN kind = 'png' THEN 'ocr' WHEN kind <> 'pdf' THEN 'plain-text' WHEN scanned = 0 THEN 'pdf-text' ELSE 'pdf-text+ocr' END AS extraction_method,
  sha256(body) AS digest, {WORDS} AS words, CASE WHEN reason IS NULL AND body = '' AND kind = 'png' THEN 'No readable text was found in this image.' WHEN reason IS NULL AND kind = 'pdf' AND length(text) % 2 = 1 THEN 'OCR failed on page 3.' END AS warnings, reason FROM whole"""
PAGE_TABLE = f"""{FILES}, each AS (SELECT doc_id, unnest(pages) AS p FROM read)
SELECT doc_id AS document_id, p.n AS page_number, sha256(p.x) AS digest, length(p.x) AS char_count, p.o AS ocr_used, p.c AS ocr_confidence FROM each"""

ORACLES: dict[str, str] = {
    "search_relevance": page("id, filename, score", ("the", "that")),
    "search_phrase": page("id, score", ("the inspection", "of")),
    "search_all_terms": ids(match("track", "inspection", "tamping")),
    "search_page2": page("id, score", ("the", "that"), offset=20),
    "search_total": f"SELECT count(*) AS total FROM ({LIB}) WHERE {match('the', 'that')} AND department IN ('Safety', 'Finance', 'IT')",
    "search_snippet": page(f"id, {snippet('extracted_text', ('inspection', 'of'))} AS snippet", ("inspection", "of"), limit=50),
    "search_escape_chars": f"{ids(match('src1_en', '100%', 'a_b'))} UNION ALL {ids(match('src1_en'))}",
    "search_highlight": f"SELECT id, len(regexp_extract_all(extracted_text, '(?i)(the|he|inspection|100%)')) AS hits, regexp_replace({snippet('extracted_text', ('inspection', 'the'))}, '(?i)(the|he|inspection|100%)', '[\\1]', 'g') AS snippet FROM ({LIB}) WHERE hits > 0",
    "search_blob": per_entry(n="length(search_blob)", digest="sha256(search_blob)"),
    "search_part_catalog": page("p_partkey, score", ("st",), table="part", by="score DESC, p_partkey DESC", limit=50, weights=PARTS, blob=("p_name", "p_type", "p_brand")),
    "search_pages_html": page("page_id, score", ("example", "the"), table="pages", by="score DESC, page_id DESC", limit=50, weights=lib.PAGES.weights, blob=("url", "html")),
    "search_events": page("event_id, score", ("k",), table="events", by="ts DESC, event_id DESC", limit=50, where="event_type IN ('click', 'view')", weights=lib.EVENTS.weights, blob=("event_type", "props")),
    "search_conversations": f"SELECT conv_id, turn, {score('user', 'the', weights={'role': 30, 'text': 10})} AS score FROM conversations WHERE {match('user', 'the', columns=('text', 'role'))}",
    "filter_department": ids("department IN ('Safety', 'Finance')"),
    "filter_priority": ids("priority = 'High'"),
    "filter_file_type": ids("file_type IN ('PDF', 'IMAGE')"),
    "filter_status_alias": ids("status IN ('analysis_complete', 'ocr_processing')"),
    "filter_status_unknown": ids("FALSE"),
    "filter_doc_type": ids("document_type IN ('Invoice', 'Tender / Contract')"),
    "filter_date_presets": f"SELECT count(*) AS any_time, count(*) FILTER (uploaded_at >= TIMESTAMP '2024-03-30') AS today, count(*) FILTER (uploaded_at >= {AS_OF} - INTERVAL 7 DAY) AS week, count(*) FILTER (uploaded_at >= {AS_OF} - INTERVAL 30 DAY) AS recent, count(*) FILTER (uploaded_at <= {AS_OF} - INTERVAL 30 DAY) AS older FROM ({LIB})",
    "filter_date_bounds": ids(f"uploaded_at >= {AS_OF} - INTERVAL 30 DAY AND uploaded_at BETWEEN TIMESTAMP '2024-03-10' AND TIMESTAMP '2024-03-20 06:00:00'"),
    "filter_combined": ids(f"{match('inspection')} AND department IN ('Safety', 'IT', 'HR') AND priority IN ('High', 'Low') AND status = 'analysis_complete' AND uploaded_at >= {AS_OF} - INTERVAL 30 DAY"),
    "filter_low_ocr": ids("ocr_used AND ocr_quality < 70"),
    "sort_newest": page("id, uploaded_at", (), by="uploaded_at DESC, id DESC"),
    "sort_oldest": page("id, uploaded_at", (), by="uploaded_at, id", offset=40),
    "sort_name": page("id, filename", (), by="lower(filename), id"),
    "sort_priority": page("id, priority", (), by=PRIORITY, limit=100),
    "sort_orders": page("o_orderkey, o_orderpriority", (), table="orders", by="CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC", limit=50),
    "facets_self_excluding": facet(f"({LIB})", {"department": "department IN ('Safety', 'Finance')", "priority": "priority = 'High'", "status": "status = 'analysis_complete'"}, KINDS, labels=True),
    "facets_with_query": facet(f"({LIB})", {"file_type": "file_type = 'PDF'"}, KINDS, f"{match('inspection', 'the')} AND uploaded_at >= {AS_OF} - INTERVAL 30 DAY", labels=True),
    "facets_orders": facet("orders", {"o_orderstatus": "o_orderstatus = 'F'", "o_orderpriority": "o_orderpriority IN ('1-URGENT', '5-LOW')"}, ORDERED["orders"]),
    "facets_events": facet("events", {"event_type": "event_type = 'click'"}, ORDERED["events"]),
    "facets_displayed": f"SELECT 'department' AS facet, value, coalesce(c, 0) AS count, value = 'Safety' AS selected, CAST(ord - 1 AS INT) AS ord FROM (SELECT unnest([{', '.join(map(q, v.DEPARTMENTS))}]) AS value, generate_subscripts([{', '.join(map(q, v.DEPARTMENTS))}], 1) AS ord) LEFT JOIN (SELECT department, count(*) AS c FROM ({LIB}) GROUP BY 1) ON value = department",
    "stats_library": f"SELECT count(*) AS total_documents, count(*) FILTER (status = 'analysis_complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'analysis_complete' AND priority = 'High') AS high_priority, count(DISTINCT department) FILTER (department NOT IN ('', 'Unassigned')) AS departments, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages, count(*) FILTER (status NOT IN ('analysis_complete', 'failed')) AS in_progress FROM ({LIB})",
    "stats_actions": f"{BASE}, a AS (SELECT id, least(count(*), 8) AS k FROM said WHERE {has('st', v.ACTION_SIGNALS)} GROUP BY id) SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS actions, count(*) AS complete FROM lib LEFT JOIN a USING (id) WHERE status = 'analysis_complete'",
    "text_clean": per_document(digest=f"sha256({strip(f'''regexp_replace(regexp_replace({CLEANED}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')''')})"),
    "text_reflow": per_document(body=f"sha256({reflow(WRAPPED)})"),
    "text_sentences": per_document(n=f"len({sentences('text')})", digest=f"sha256(array_to_string({sentences('text')}, '|'))"),
    "text_tokens": per_document(n=f"len({tokens('text')})", digest=f"sha256(array_to_string({tokens('text')}, '|'))"),
    "text_upper_ratio": per_document(ratio=f"round({ratio('text')}, 9)"),
    "text_trim": per_document(short=trim_to("text", 220)),
    "text_word_count": per_document(words="len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))", chars="length(text)"),
    "text_language": per_entry(language=language("extracted_text"), own=language("left(extracted_text, 60)")),
    "text_title_from_filename": per_entry(title=filename_title("('final__report2b-' || filename)")),
    "text_safe_filename": per_entry(safe=f"left({SAFE}, 200)"),
    "text_file_type": per_entry(kind="file_type", ext="lower(regexp_extract(filename, '\\.([^.]+)$', 1))"),
    "text_chunk": per_document(text="substr(text, 101, 400)", total_chars="length(text)", has_more="500 < length(text)"),
    "text_preview": per_document(preview="sha256(left(text, 4000))"),
    "text_sha256": per_document(checksum="sha256(text)"),
    "text_phrase_count": per_entry(the=count(tag("extracted_text"), "the"), of_the=count(tag("extracted_text"), "of the"), subject=count(tag("extracted_text"), "subject:"), safety=count(tag("extracted_text"), "safety")),
    "rule_department": f"{BASE} SELECT id, department FROM judged",
    "rule_secondary": f"{BASE} SELECT id, array_to_string(list_transform(list_filter(list_slice(ranked, 2, 4), lambda d: d.score >= greatest(2, top * 0.35)), lambda d: d.name), '|') AS secondary FROM judged",
    "rule_doc_type": f"{BASE} SELECT id, coalesce(({best(v.DOCUMENT_TYPE_KEYWORDS, 14, 3)})[1].name, 'Other') AS document_type FROM tagged",
    "rule_priority": f"{BASE} SELECT id, priority FROM prior",
    "rule_keywords": KEYWORDS,
    "rule_summary": SUMMARY,
    "rule_actions": listed(ACTION, has("st", v.ACTION_SIGNALS), 8, "actions", "JOIN prior USING (id)"),
    "rule_deadlines": DEADLINES,
    "rule_risks": listed(trim_to("s", 200), has("st", v.RISK_SIGNALS), 5, "risks"),
    "rule_flags": f"{BASE} SELECT id, array_to_string(list_slice(list_filter([{', '.join(f'CASE WHEN {has(TAGS, [s])} THEN {q(s.title())} END' for s in sorted(v.COMPLIANCE_SIGNALS))}], lambda f: f IS NOT NULL), 1, 6), '|') AS flags FROM tagged",
    "rule_title": TITLE,
    "rule_confidence": f"{BASE} SELECT id, floor((1680000 + 420 * least(length(body), 4000) + 100000 * least(top, 12) + 24000) / 48000) / 100.0 AS confidence FROM judged",
    "normalise_department": f"SELECT doc_id, {alias(v.DEPARTMENT_ALIASES, v.DEPARTMENTS, q('Unassigned'))} AS department FROM {CASED}",
    "normalise_priority": f"SELECT doc_id, {alias(v.PRIORITY_ALIASES, v.PRIORITIES, q('Medium'))} AS priority FROM {CASED}",
    "normalise_doc_type": f"SELECT doc_id, {alias({}, v.DOCUMENT_TYPES, '''coalesce(nullif(left(trim(c), 60), ''), 'Other')''')} AS document_type FROM {CASED}",
    "status_labels": per_entry(label=LABEL),
    "llm_postprocess": f"""SELECT id, trim(regexp_replace(r->>'title', '\\s+', ' ', 'g')) AS title, department, CASE id % 4 WHEN 1 THEN 'High' WHEN 3 THEN 'Low' ELSE 'Medium' END AS priority, coalesce(nullif(document_type, ''), 'Other') AS document_type, least(greatest(CASE WHEN r->>'confidence' <> 'high' THEN CAST(r->>'confidence' AS DOUBLE) END, CASE WHEN r->>'confidence' <> 'high' THEN 0.0 END), CASE WHEN r->>'confidence' <> 'high' THEN 1.0 END) AS confidence, 'alpha|beta' AS keywords, 'late' AS risks, 1 AS n_actions FROM (SELECT *, CAST({REPLY} AS JSON) AS r FROM ({LIB}))""",
    "json_decode_lists": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN source || '|' || lang ELSE '' END AS items FROM documents",
    "format_bytes": f"SELECT doc_id, CASE WHEN p = 0 THEN printf('%.0f B', x) ELSE printf(CASE WHEN x / pow(1024, p) >= 10 THEN '%.0f ' ELSE '%.1f ' END, x / pow(1024, p)) || (['KB', 'MB', 'GB'])[p] END AS size FROM (SELECT doc_id, CAST({SIZE} AS DOUBLE) AS x, CASE WHEN {SIZE} < 1024 THEN 0 WHEN {SIZE} < 1048576 THEN 1 WHEN {SIZE} < 1073741824 THEN 2 ELSE 3 END AS p FROM documents)",
    "relative_time": f"""SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN h < 24 THEN h || ' hr ago' WHEN d = 1 THEN '1 day ago' WHEN d < 30 THEN d || ' days ago' ELSE strftime(uploaded_at, '%d %b %Y') END AS "when"
FROM (SELECT *, CAST(floor(h / 24.0 + 0.5) AS BIGINT) AS d FROM (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM (SELECT id, uploaded_at, CAST(floor(date_diff('millisecond', uploaded_at, {AS_OF}) / 60000.0 + 0.5) AS BIGINT) AS m FROM ({LIB}))))""",
    "ingest_batch_text": f"SELECT 'analysis_complete' AS status, 'Unassigned' AS department, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, sha256({strip('text')}) AS digest FROM benchmark",
}
ORACLES |= {
    "search_analysed": SEARCH_ANALYSED,
    "rule_blob": f"SELECT id, length(search_blob) AS n, sha256(search_blob) AS digest, action_count, deadline_count FROM ({ANALYSED})",
    "llm_fallback": FALLBACK,
    "extract_files": EXTRACT,
    "page_table": PAGE_TABLE,
    "filter_in_progress": ids("status NOT IN ('analysis_complete', 'failed')"),
    "json_encode_lists": per_document(items="'[' || to_json(source)::VARCHAR || ', ' || to_json(substr(text, 1, 30))::VARCHAR || ', ' || to_json('é \"q\" \\')::VARCHAR || ']'"),
    "store_lifecycle": f"SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 'back' ELSE 'again' END AS uploaded_by, 'analysis_complete' AS status, sha256({strip('text')}) AS digest, 1 AS pages FROM benchmark WHERE item_id % 3 <> 0 OR item_id % 6 = 0",
}
FILE = "encode(text || chr(10))"
READ = "item_id % 2 = 0"
ORACLES |= {
    "store_stages": f"""SELECT item_id, CASE WHEN {READ} THEN 'analysis_complete' ELSE 'processing' END AS status, CASE WHEN {READ} THEN 'Analysed with rule engine' ELSE 'Queued for text extraction' END AS status_detail,
      CASE WHEN {READ} THEN 1 ELSE 0 END AS pages, octet_length({FILE}) AS size_bytes, sha256({FILE}) AS checksum, item_id % 2 <> 0 AS name_only FROM benchmark""",
    "store_downloads": f"SELECT item_id, octet_length({FILE}) AS size_bytes, sha256({FILE}) AS checksum FROM benchmark",
    "document_detail": f"SELECT * EXCLUDE (extracted_text, search_blob), left(extracted_text, 4000) AS text_preview FROM ({LIB}) WHERE id = 77",
    "rule_empty_body": f"""SELECT id, {filename_title('name')} AS title, coalesce(({best(v.DOCUMENT_TYPE_KEYWORDS, 14, 3)})[1].name, 'Other') AS document_type, 'Unassigned' AS department, 'Medium' AS priority,
      {q(NO_TEXT)} AS summary, 0.15 AS confidence, 0 AS entries FROM (SELECT id, {UNREAD} AS name, {tag(UNREAD)} AS tags FROM ({LIB}))""",
}
ORACLES["ingest_stream_text"] = ORACLES["ingest_batch_text"]

STRIPPED = strip("text")
SHAPED = "id % 8 IN (5, 6)"
ORACLES |= {
    "search_indexed": " UNION ALL ".join(f"SELECT {n} AS query, id FROM ({LIB}) WHERE {match(*parse_terms(asked))}" for n, asked in enumerate(SEARCHES)),
    "search_ranked": ORACLES["search_page2"],
    "search_ranked_snippet": ORACLES["search_snippet"],
    "search_seek": page("id, uploaded_at", (), by="uploaded_at DESC, id DESC", limit=15, offset=30),
    "facets_bitmap": ORACLES["facets_self_excluding"],
    "facets_bitmap_query": ORACLES["facets_with_query"],
    "stats_bitmap": ORACLES["stats_library"].replace(f"({LIB})", f"(SELECT * FROM ({LIB}) WHERE id % 7 <> 3)"),
    "store_two_streams": f"SELECT item_id, 'stream ' || (item_id % 2) AS uploaded_by, 'analysis_complete' AS status, sha256({STRIPPED}) AS digest FROM benchmark",
    "store_delete": f"SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 'again' ELSE 'first' END AS uploaded_by, sha256({STRIPPED}) AS digest FROM benchmark WHERE item_id % 3 <> 0 OR item_id % 6 = 0",
    "store_purge": "SELECT item_id, unnest(['document', 'file']) AS kind FROM benchmark WHERE item_id % 3 <> 0",
    "store_failed": """SELECT item_id, 'failed' AS status, CASE WHEN item_id % 2 = 0 THEN 'Safety Circular' ELSE 'Tender' END AS title, '' AS document_type, 'Unassigned' AS department, 'Medium' AS priority, '' AS summary,
      CASE WHEN item_id % 2 = 0 THEN 'safety circular.docx' ELSE 'tender.exe' END AS search_blob, 'Unknown' AS language, 0 AS word_count, TRUE AS no_confidence, 0 AS entries FROM benchmark""",
    "store_chunks": f"SELECT doc_id AS id, sha256(text) AS digest, (length(text) + {CHUNK - 1}) // {CHUNK} AS chunks FROM documents WHERE text <> ''",
    "llm_wrong_shapes": f"""SELECT l.id, CASE WHEN id % 8 = 5 THEN l.department WHEN id % 8 = 6 THEN 'Unassigned' ELSE p.department END AS department, CASE id % 8 WHEN 5 THEN 'Medium' WHEN 6 THEN 'High' ELSE p.priority END AS priority,
      CASE WHEN {SHAPED} THEN 'model' ELSE 'rule-based' END AS analysis_engine, CASE WHEN id % 8 < 5 THEN {NOTE.format("'unreadable reply'")} ELSE '' END AS analysis_error, CASE id % 8 WHEN 5 THEN 1 WHEN 6 THEN 0 END AS asked
      FROM ({LIB}) l JOIN ({BASE} SELECT id, department, priority FROM prior) p USING (id)""",
}
RENEWED = f"SELECT * REPLACE ('High' AS priority, 'analysis_complete' AS status, 2 AS page_count) FROM ({LIB}) WHERE id % 5 = 0"
STEPS = (f"({LIB})", f"(SELECT * FROM ({LIB}) WHERE id % 7 <> 3)", *[f"(SELECT * FROM ({LIB}) WHERE id % 7 <> 3 AND id % 5 <> 0 UNION ALL {RENEWED})"] * 2)
ORACLES |= {
    "store_progress": """SELECT v.version, v.version - 1 AS stage, CASE WHEN v.version < 3 THEN 'processing' WHEN item_id % 5 = 0 THEN 'failed' WHEN v.version = 3 THEN 'ai_analysis' ELSE 'analysis_complete' END AS status, count(*) AS documents
      FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS version) v GROUP BY ALL""",
    "store_live_figures": " UNION ALL ".join(f"SELECT *, {n} AS step FROM ({ORACLES['stats_library'].replace(f'({LIB})', rows)})" for n, rows in enumerate(STEPS)),
}
