"""Packing of documents into sequences of bounded length, attention cost and document count.

Vector best-fit: every open sequence has three residual capacities, tokens,
documents and attention cost (the sum of squared piece lengths). A piece, the
longest first, goes where it fits under all three and leaves the residual
vector with the smallest weighted norm, or else into a new sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.bpe import library_bpe
from papyra.llm.common import checkpointed, map_batches, out


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. The defaults for documents and attention can hold whatever the tokens can; weights are of the residual norm."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)

    def __post_init__(self):
        if self.documents < 1 or self.attention < self.tokens**2:
            raise ValueError("a piece of full length must fit into an empty sequence")


#: Pieces that one task packs. Each such block wastes part of one sequence at most besides what best-fit itself leaves.
BLOCK_PIECES = 400_000


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", tokens: int = 2048, separator: int = 0, keep: bool = True) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and with keep ids (little-endian 32-bit).

    A document's ids are its text's and one separator; only what is longer than
    tokens is cut. Null texts count as empty and give one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, width = library_bpe(tokenizer), separator.to_bytes(4, "little"), 4 * tokens
        for batch in batches:
            rows, number, starts, lengths, sums, ids = [], [], [], [], [], []
            for row, encoded in enumerate(coder.encode_all(batch.column(1))):
                encoded += end
                for at in range(0, len(encoded), width):
                    part = encoded[at : at + width]
                    rows.append(row)
                    number.append(at // width)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if keep:
                        ids.append(part)
            yield out([key, "piece", "start", "length", "ids_crc32", *["ids"] * keep], [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)), *[pa.array(ids, pa.binary())] * keep])

    return map_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep)


class Bins:
    """Open sequences by residual tokens and documents, in the order of their residual attention cost.

    Of those with equal tokens and documents the one with the least sufficient
    attention has the smallest norm. Bounds for all with equal tokens, by their
    least documents and attention, say which of them are to be looked at.
    """

    def __init__(self, capacity: Capacity):
        self.c, self.count = capacity, 0
        full = capacity.tokens + 1
        self.levels: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(full)]  # documents left: (attention left, number)
        self.documents, self.least, self.most = (np.full(full, -1, dtype=np.int64) for _ in range(3))

    def _bounds(self, left: int) -> None:
        groups = self.levels[left]
        self.documents[left] = min(groups, default=-1)
        self.least[left] = min((g[0][0] for g in groups.values()), default=-1)
        self.most[left] = max((g[-1][0] for g in groups.values()), default=-1)

    def norm(self, tokens, documents, attention):
        """Weighted norm, squared, of residuals."""
        c = self.c
        return c.weights[0] * (tokens / c.tokens) ** 2 + c.weights[1] * (documents / c.documents) ** 2 + c.weights[2] * (attention / c.attention) ** 2

    def _best(self, left: int, length: int) -> tuple[float, int, int, int]:
        """Norm, documents left, place in their group, and number of the best sequence of a level."""
        found = (np.inf, 0, 0, 0)
        for documents, group in self.levels[left].items():
            at = bisect_left(group, (length * length,))
            if at < len(group):
                found = min(found, (self.norm(left - length, documents - 1, group[at][0] - length * length), documents, at, group[at][1]))
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Number of the sequence and offset in it."""
        c, cost, best = self.c, length * length, (np.inf, 0, 0, 0)
        levels = length + np.flatnonzero(self.most[length:] >= cost)
        if len(levels):
            bounds = self.norm(levels - length, self.documents[levels] - 1, np.maximum(self.least[levels] - cost, 0))
            while bounds[at := int(np.argmin(bounds))] < best[0]:
                here = self._best(int(levels[at]), length)
                if here[0] < best[0]:
                    best, left = here, int(levels[at])
                bounds[at] = np.inf
        if best[0] < np.inf:
            _, held, at, number = best
            attended, _ = self.levels[left][held].pop(at)
            if not self.levels[left][held]:
                del self.levels[left][held]
            self._bounds(left)
        else:
            left, held, attended, number = c.tokens, c.documents, c.attention, self.count
            self.count += 1
        after = left - length
        if after and held > 1:
            insort(self.levels[after].setdefault(held - 1, []), (attended - cost, number))
            self._bounds(after)
        return number, c.tokens - left


def pack_lengths(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; lengths are best given in descending order."""
    bins, sequence, offset = Bins(capacity), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        sequence[i], offset[i] = bins.place(length)
    return sequence, offset


def pack(parts: DataFrame, key: str = "doc_id", capacity: Capacity = Capacity(), block: int = BLOCK_PIECES) -> DataFrame:
    """parts (key, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt by a hash of their row's number into as many blocks as keep
    each under about block rows, whatever keys are repeated or null; a block is
    packed in one task, whose memory that bounds. The numbers are of checkpointed
    rows, so they stay, and a retried task packs alike, as it sorts its rows
    first. An empty table gives an empty one.
    """
    parts = checkpointed(parts.select(key, "piece", "start", "length", "ids_crc32"))
    dealt = parts.withColumn("__row", F.monotonically_increasing_id())
    blocks = max(1, -(-parts.count() // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        sequence += TaskContext.get().partitionId() << 40
        yield from rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=50_000)

    return map_batches(dealt.repartition(blocks, "__row").drop("__row"), run, f"`{key}` {parts.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: Capacity = Capacity()) -> DataFrame:
    """pieces() packed by pack(): one row per piece with its sequence and its place there.

    Nulls count as empty texts; repeated rows are packed as often as they come;
    columns other than key and text are not read.
    """
    return pack(pieces(df, key, text, tokenizer, capacity.tokens, keep=False), key, capacity)
