"""URL filters: all wildcard rules run at once as one bit-parallel automaton.

Every rule becomes a glob over the canonical URL (host, then path). All globs
share one bit vector of as many 64-bit words as they need, a bit for each
number of literals consumed. One character of every URL of a batch is
consumed at a time by the Shift-And step

    D = ((D << 1) & B[c]) | (D & L[c])

where B[c] has the literals equal to c and L[c] the wildcards that may take c.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyra.llm.common import map_batches, out

#: (verdict, host, path): the rule fits its host and all its subdomains.
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that a host is blocked for, and globs of what else is, where no host rule fits; ** takes any characters, * none that is a slash.
HOST_WORDS = ("ads-track", "casino", "cheap-pills", "porn", "spam-farm")
OTHER_GLOBS = ("ads.**", "*.ads.**", "**/wp-login*", "**.exe")
BLOCK_GLOBS = (*(g for w in HOST_WORDS for g in (f"*{w}*", f"*{w}*/**")), *OTHER_GLOBS)

_LOWER = {c: c + 32 for c in range(65, 91)}


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


@dataclass(frozen=True)
class Glob:
    """literals, and for each place before, between and after them what a wildcard there takes: '' nothing, '*' no slash, '**' anything."""

    literals: str
    loops: tuple[str, ...]

    @staticmethod
    def parse(text: str) -> Glob:
        literals, loops, i = [], [""], 0
        while i < len(text):
            if text[i] == "*":
                wide = text[i : i + 2] == "**"
                loops[-1] = "**" if wide or loops[-1] == "**" else "*"
                i += 2 if wide else 1
                continue
            i += text[i] == "\\" and i + 1 < len(text)
            literals.append(text[i])
            loops.append("")
            i += 1
        return Glob("".join(literals), tuple(loops))


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("*", "\\*")


def host_globs(host: str, path: str) -> list[str]:
    """Globs that fit the host itself and every subdomain, the path's beginning being path."""
    ends = [escaped(path) + "**"] if path else ["", "/**"]
    return [start + escaped(host) + end for start in ("", "*.") for end in ends]


def read_rules(spark: SparkSession, path: str) -> tuple[tuple[tuple[str, str, str], ...], tuple[str, ...]]:
    """Host rules and globs of a list: lines like "allow org/", "block example.org/es/" or "glob *.ads.**"; empty ones and those after # say nothing.

    A list comes to the driver whole, and its bits to every task: some thousand rules.
    """
    hosts, globs = [], []
    for line in (r.value.partition("#")[0].strip() for r in spark.read.text(path).collect()):
        verdict, _, what = line.partition(" ")
        host, slash, rest = what.strip().partition("/")
        if verdict == "glob" and what.strip():
            globs.append(what.strip())
        elif verdict in ("allow", "block") and host:
            hosts.append((verdict, host.lower(), slash + rest))
        elif line:
            raise ValueError(f"not a rule: {line}")
    return tuple(hosts), tuple(globs)


class Automaton:
    """Shift-And over all globs; matches(texts) gives a row per text and a column per glob."""

    def __init__(self, globs: list[Glob]):
        self.size = sum(len(g.literals) + 1 for g in globs)
        words = max(1, (self.size + 63) // 64)
        alphabet = sorted({c for g in globs for c in g.literals} | {"/"})
        #: Class 0 holds the characters that no rule names.
        self.known = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        self.step = np.zeros((len(alphabet) + 1, words), dtype=np.uint64)
        self.stay = np.zeros_like(self.step)
        self.start = np.zeros(words, dtype=np.uint64)
        self.final, at = [], 0
        for g in globs:
            self._set(self.start, at)
            for i, loop in enumerate(g.loops):
                if i:
                    self._set(self.step[alphabet.index(g.literals[i - 1]) + 1], at + i)
                for c in range(len(alphabet) + 1) if loop else ():
                    if loop == "**" or c == 0 or alphabet[c - 1] != "/":
                        self._set(self.stay[c], at + i)
            at += len(g.literals) + 1
            self.final.append(at - 1)

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << bit % 64)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, codes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == codes, at + 1, 0)

    def matches(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if texts else lengths
        classes = self.classes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        order = np.argsort(-lengths, kind="stable")
        starts, ordered = starts[order], lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        active = len(texts)
        for place in range(int(ordered[0]) if active else 0):
            active = int(np.searchsorted(-ordered, -place, side="left"))  # the texts longer than place
            now = state[:active]
            c = classes[starts[:active] + place]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[c]) | (now & self.stay[c])
        found = np.empty((len(texts), len(self.final)), dtype=bool)
        for k, bit in enumerate(self.final):
            found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return found


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", host_rules=HOST_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """One row per row of df: key, host, path, rule, verdict.

    The longest host rule that fits decides (host and path together; the first
    of equally long ones); elsewhere a fitting glob blocks and all else is
    allowed. Null URLs and such without :// have an empty host and path, which
    no host rule fits. Repeated rows stay; an empty table gives an empty one;
    further columns are not read. Nothing is shuffled.
    """
    rules = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    globs = [(k, g) for k, (_, host, path) in enumerate(rules) for g in host_globs(host, path)]
    automaton = Automaton([Glob.parse(g) for _, g in globs] + [Glob.parse(g) for g in block_globs])
    of_rule = np.array([k for k, _ in globs], dtype=np.int64)
    verdicts, names = [r[0] for r in rules], [r[1] + r[2] for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            found = automaton.matches([h + p for h, p in parts])
            fits = np.full(len(parts), len(rules))
            for column, k in enumerate(of_rule):
                fits[found[:, column] & (fits > k)] = k
            blocked = found[:, len(of_rule) :].any(axis=1)
            rule = [names[k] if k < len(names) and h else None for k, (h, _) in zip(fits, parts, strict=True)]
            verdict = [verdicts[k] if r is not None else "block" if b else "allow" for k, r, b in zip(fits, rule, blocked, strict=True)]
            yield out([key, "host", "path", "rule", "verdict"], [batch.column(0), [h for h, _ in parts], [p for _, p in parts], pa.array(rule, pa.string()), verdict])

    return map_batches(df.select(key, url), run, f"`{key}` {df.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string")


def sql(table: str = "pages", host_rules=HOST_RULES, block_globs=BLOCK_GLOBS) -> str:
    """The same for DuckDB, with regular expressions in place of the automaton."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def regex(g: Glob) -> str:
        loops = {"": "", "*": "[^/]*", "**": "(?s:.*)"}
        parts = [loops[g.loops[0]]]
        for c, loop in zip(g.literals, g.loops[1:], strict=True):
            parts.append((c if c.isalnum() or c in "-/" else "\\" + c) + loops[loop])
        return "".join(parts)

    rules = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)}) THEN" for _, h, p in rules]
    case = lambda values: "CASE " + " ".join(f"{f} {quote(v)}" for f, v in zip(fits, values, strict=True))
    globs = " OR ".join(f"regexp_full_match(host || path, {quote(regex(Glob.parse(g)))})" for g in block_globs) or "FALSE"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {table}
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts
)
SELECT page_id, host, path, {case([h + p for _, h, p in rules])} END AS rule,
  {case([v for v, _, _ in rules])} ELSE CASE WHEN {globs} THEN 'block' ELSE 'allow' END END AS verdict
FROM urls"""
