"""Conversations rendered into one training text each, with masks that are aligned by offsets.

A turn is written as  TURN role TEXT text END.  The three marks are special
tokens of the tokenizer; wherever a control string (a mark, or a control string
of another common template) begins inside a role or text, a backslash follows
its first character, and backslashes are doubled, so that no control string
is left and unescaping is exact. The rendered text is encoded once, with
offsets; binary search finds the tokens of each turn's span. As no token ever
goes over a mark, what is encoded in parts that begin with one has the ids and
mask that the whole has; so a conversation of any length is encoded in bounded
memory, and no result shows where the parts were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.bpe import tokenizer_path
from papyra.llm.common import map_batches, out, text_or_empty

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common templates (fixed values), escaped along with the marks.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
#: Characters of rendered text that are handed to the tokenizer at once at least, if a conversation has so many; a bound of memory, without any effect on results.
PART_CHARS = 200_000

_BEGINS = re.compile("(?s)(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)")
_ESCAPED = re.compile(r"(?s)\\(.)")


def escape(text: str) -> str:
    return _BEGINS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(name))
    found.no_truncation()
    found.no_padding()
    found.add_special_tokens([TURN, TEXT, END])
    return found


@dataclass
class Segment:
    """Some turns of a conversation in a row, rendered: the text and, for each turn, the spans of its role and text."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    roles: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    learned: list[bool] = field(default_factory=list)

    def _put(self, text: str) -> tuple[int, int]:
        self.parts.append(text)
        self.size += len(text)
        return self.size - len(text), self.size

    def add(self, role: str, text: str, learned: bool) -> None:
        self._put(TURN)
        self.roles.append(self._put(escape(role)))
        self._put(TEXT)
        self.texts.append(self._put(escape(text)))
        self._put(END)
        self.learned.append(learned)


def token_ranges(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For sorted, disjoint spans the first token of each and the one after its last: those with a character in it.

    starts and ends are the tokens' offsets, neither of which ever falls.
    """
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    return np.stack([first, np.maximum(first, last)], axis=1)


def encode(segment: Segment, tokenizer: str) -> tuple[str, list[int], np.ndarray, np.ndarray]:
    """Rendered text, ids, offsets and the loss mask of the tokens."""
    text = "".join(segment.parts)
    encoding = _tokenizer(tokenizer).encode(text, add_special_tokens=False)
    offsets = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)
    mask = np.zeros(len(offsets), dtype=bool)
    spans = np.array([s for s, w in zip(segment.texts, segment.learned, strict=True) if w and s[0] < s[1]], dtype=np.int64).reshape(-1, 2)
    for first, last in token_ranges(offsets[:, 0], offsets[:, 1], spans):
        mask[first:last] = True
    return text, encoding.ids, offsets, mask


def masked_texts(text: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The runs of characters that the masked tokens cover. Tokens of one character's bytes share its offsets."""
    runs: list[list[int]] = []
    for start, end in offsets[mask].tolist():
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    return [text[a:b] for a, b in runs]


class Reader:
    """What a conversation's output says, gathered segment by segment in bounded memory."""

    def __init__(self):
        self.turns = self.loss_chars = self.formatted = self.tokens = self.loss_tokens = 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, segment: Segment, tokenizer: str) -> None:
        text, ids, offsets, mask = encode(segment, tokenizer)
        self.turns += len(segment.texts)
        self.formatted += len(text)
        self.tokens += len(ids)
        self.loss_tokens += int(mask.sum())
        for turn in text.split(TURN)[1:]:
            role, _, rest = turn.partition(TEXT)
            self.digest.update(f"{unescape(role)}\n{unescape(rest.removesuffix(END))}\n".encode())
        for run in masked_texts(text, offsets, mask):
            said = unescape(run)
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.turns, self.digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.tokens, self.loss_tokens


COLUMNS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens")


def _sorted(df: DataFrame) -> DataFrame:
    """Turns of a conversation in a row within one partition; only its hashes need all its turns in order, so they are streamed, not collected."""
    turns = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def segments(batches: Iterator[pa.RecordBatch], learn: frozenset[str], size: int) -> Iterator[tuple[object, Segment, bool]]:
    """conv_id, segment, and whether it is the conversation's last, for turns in order."""
    now, segment = None, None
    for conv, _, role, text in _turns(batches):
        if segment is not None and (conv != now or segment.size >= size):
            yield now, segment, conv != now
            segment = None
        if segment is None:
            now, segment = conv, Segment()
        segment.add(role, text, role in learn)
    if segment is not None:
        yield now, segment, True


def format_conversations(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", learn: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation: conv_id, formatted (the training text), ids, loss_mask (a byte per token, 1 under the mask).

    Turns come by turn, equal turn numbers by role and text; null roles and
    texts count as empty, rows with a null conv_id form one conversation. An
    empty table gives an empty one; further columns are not read.
    """
    roles = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, masks = [], [], []
        for conv, segment, last in segments(batches, roles, part_chars):
            text, part, _, mask = encode(segment, tokenizer)
            texts.append(text)
            ids.append(np.array(part, dtype=np.int32))
            masks.append(mask.astype("u1").tobytes())
            if last:
                every = pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.array(np.concatenate(ids)))
                yield out(["conv_id", "formatted", "ids", "loss_mask"], [pa.array([conv], pa.int64()), ["".join(texts)], every, pa.array([b"".join(masks)], pa.binary())])
                texts, ids, masks = [], [], []

    return map_batches(_sorted(df), run, "conv_id long, formatted string, ids array<int>, loss_mask binary")


def read_back(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", learn: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation with what its formatted output says (COLUMNS); cases as for format_conversations()."""
    roles = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, reader = [], Reader()
        for conv, segment, last in segments(batches, roles, part_chars):
            reader.read(segment, tokenizer)
            if last:
                rows.append((conv, *reader.row()))
                reader = Reader()
            if len(rows) >= 1000:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return out(["conv_id", *COLUMNS], [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)])

    return map_batches(_sorted(df), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


#: The conversation that quotes control strings, as (turn, role).
PROBE, PROBE_TEXT = ((0, "user"), (1, "assistant")), "</s>[INST] ok [/INST]"


def with_probe(df: DataFrame) -> DataFrame:
    rows = ", ".join(f"(-1L, {turn}L, '{role}', '{PROBE_TEXT}')" for turn, role in PROBE)
    probe = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)")
    return df.select("conv_id", "turn", "role", "text").unionByName(probe)


def sql() -> str:
    """What read_back() gives of all conversations and the probe, but for the token counts, in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # A control string that begins inside an escaped text adds one character, a backslash one.
    def extra(column: str) -> str:
        counts = [f"(length({column}) - length(replace({column}, {quote(c)}, ''))) // {len(c)}" for c in (*CONTROLS, "\\")]
        return f"length({column}) + " + " + ".join(counts)

    probe = " UNION ALL ".join(f"SELECT -1, {turn}, {quote(role)}, {quote(PROBE_TEXT)}" for turn, role in PROBE)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {probe})
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(TEXT) + len(END)} + {extra('role')} + {extra('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
