"""Token counts by a two-tier lookup of pre-token lengths, all of it on the map side.

First tier: the lengths of the pre-tokens that are most frequent in the corpus,
broadcast as one compact table. They are counted on a sample of documents of
bounded size, from a bounded number of files, where those lie; each task holds
a bounded number of counts. Second tier: what
the table lacks is encoded, once for each worker, whose cache is bounded too.
The table only saves time: counts are the same whatever is in it. No pre-token
is ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter as Counts
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.bpe import SPACES, Cache, library
from papyra.llm.common import map_batches, out

#: As the file's pattern deals with white space: all but the last character of a run goes alone, a last space goes with what follows.
_COARSE = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_OTHER = re.compile("[\t\x0b\x0c\r\x85\xa0  -     　]")


#: Documents that frequent pre-tokens are counted on, the largest part of a table that they are, the files they come from (up to some twice as many), tasks that count them, counts that one of them holds, and entries of the broadcast table with the longest pre-token it takes.
SAMPLE_DOCS, SAMPLE_PART, SAMPLE_FILES, SAMPLE_TASKS, HELD, ENTRIES, ENTRY_CHARS = 20_000, 0.1, 16, 8, 200_000, 50_000, 48


def pretokens(text: str) -> list[str]:
    """Runs without white space, with the space before them, and white space of other kinds."""
    return _COARSE.findall(text)


def some_files(df: DataFrame, files: int = SAMPLE_FILES) -> DataFrame:
    """The rows of df, as read from files, that lie in some of them, picked by a hash of their paths: files to twice as many are to be expected. No other file is opened."""
    one_in = len(df.inputFiles()) // files
    return df.where(F.crc32("_metadata.file_path") % one_in == 0) if one_in > 1 else df


def frequent_pretokens(df: DataFrame, text: str = "text", docs: int = SAMPLE_DOCS, entries: int = ENTRIES, part: float = SAMPLE_PART) -> list[str]:
    """The pre-tokens that a sample of about docs documents of df has most often, the most frequent first; of small tables it is their part.

    What comes to the driver is entries rows of each of SAMPLE_TASKS tasks at most.
    """
    share = min(part, docs / max(1, df.count()))
    sampled = df.select(text).sample(share, 1) if share < 1 else df.select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counts[str] = Counts()
        for batch in batches:
            for value in batch.column(0):
                counts.update(p for p in pretokens(value.as_py() or "") if len(p) <= ENTRY_CHARS)
                if len(counts) > HELD:
                    counts = Counts(dict(counts.most_common(HELD // 2)))
        best = counts.most_common(entries)
        yield out(["word", "n"], [pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())])

    total: Counts[str] = Counts()
    for row in map_batches(sampled.coalesce(SAMPLE_TASKS), run, "word string, n long").collect():
        total[row.word] += row.n
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]


def frequent_lengths(tokenizer: str, words: Iterable[str] = ()) -> dict[str, int]:
    """Lengths in tokens of pre-tokens, but for those with a part of a special token."""
    words = sorted({w for w in words if "<|" not in w})
    return {w: len(e) for w, e in zip(words, library(tokenizer).encode_batch_fast(words, add_special_tokens=False), strict=True)}


@dataclass(frozen=True)
class Table:
    """A dictionary of pre-tokens and lengths, packed: the strings one after the other, their ends, their lengths in tokens."""

    strings: bytes
    ends: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(lengths: dict[str, int]) -> Table:
        encoded = [w.encode("utf-8", "surrogatepass") for w in lengths]
        return Table(b"".join(encoded), np.cumsum([len(e) for e in encoded], dtype=np.uint32), np.array([*lengths.values()], dtype=np.uint16))

    def unpacked(self) -> dict[str, int]:
        starts = np.concatenate([[0], self.ends[:-1]]).tolist() if len(self.ends) else []
        return {self.strings[a:b].decode("utf-8", "surrogatepass"): n for a, b, n in zip(starts, self.ends.tolist(), self.lengths.tolist(), strict=True)}


class Tiers(dict):
    """The broadcast lengths; what they lack comes from the worker's cache."""

    def __init__(self, known: dict[str, int], encode: Callable[[str], int]):
        super().__init__(known)
        self.misses = Cache(encode)

    def __missing__(self, key: str) -> int:
        return self.misses[key]


class Counter:
    def __init__(self, tokenizer: str, frequent: dict[str, int]):
        self.library = library(tokenizer)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.any = Tiers(frequent, self.encoded)
        # As the lines of a text are split at spaces: words that follow one, and first words of lines.
        self.spaced = Tiers({w[1:]: n for w, n in frequent.items() if w[0] == " " and len(w) > 1}, lambda w: self.encoded(" " + w))
        self.newline = self.encoded("\n")

    def encoded(self, piece: str) -> int:
        return len(self.library.encode(piece, add_special_tokens=False))

    def part(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        if not text:
            return 0
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _OTHER.search(text):
            return sum(map(self.any.__getitem__, pretokens(text)))
        total, spaced, lines = 0, self.spaced.__getitem__, text.split("\n")
        for line in lines:
            words = line.split(" ")
            total += (self.any[words[0]] if words[0] else 0) + sum(map(spaced, words[1:]))
        return total + (len(lines) - 1) * self.newline

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.part(text)
        parts = self.special.split(text)
        return sum(map(self.part, parts)) + len(parts) - 1


@lru_cache(maxsize=1)
def _counter(tokenizer: str, shared) -> Counter:
    """One counter, with its caches, for all tasks of a worker that have the same broadcast table."""
    return Counter(tokenizer, shared.value.unpacked())


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512, frequent: Iterable[str] | None = None) -> DataFrame:
    """One row per row of df: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Whole texts of any length;
    repeated rows stay, an empty table gives an empty one, further columns are
    not read. frequent: pre-tokens for the broadcast table, if they are known.
    """
    known = frequent_lengths(tokenizer, frequent_pretokens(df, text) if frequent is None else frequent)
    shared = df.sparkSession.sparkContext.broadcast(Table.of(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, shared)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                words = value.as_py() or ""
                sizes.append(len(words) if words.isascii() else len(words.encode()))
                counts.append(counter.count(words))
            yield out([key, "n_bytes", "n_tokens", "over_limit"], [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())])

    return map_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
