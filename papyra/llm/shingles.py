"""Weighted word shingles of many texts at once, as arrays.

Words are the runs between U+0020 and U+0009 to U+000D, a shingle five of them
in a row (all of a text with fewer), its weight how often the text has it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that are worked on at once; each takes some 20 bytes of memory.
PIECE_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the finaliser of SplitMix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _odd(seed: int, count: int) -> np.ndarray:
    return mixed(np.arange(count, dtype=np.uint64) + _U(seed << 32)) | _U(1)


def _pieces(buffer: bytes):
    """Pieces that end between words."""
    at = 0
    while at < len(buffer):
        end = at + PIECE_BYTES
        while end < len(buffer) and not _SPACE[buffer[end]]:
            end += 1
        yield buffer[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    hashes, starts_all, at = [], [], 0
    for piece in _pieces(b"\n".join(texts)):
        data = np.frombuffer(piece, dtype=np.uint8)
        inside = np.flatnonzero(~_SPACE[data])
        if len(inside):
            first = np.empty(len(inside), dtype=bool)
            first[0] = True
            np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
            starts = np.flatnonzero(first)
            lengths = np.diff(np.append(starts, len(inside)))
            place = np.arange(len(inside)) - np.repeat(starts, lengths)
            power = _odd(1, 1 << max(6, int(lengths.max() - 1).bit_length()))
            sums = np.add.reduceat((data[inside].astype(np.uint64) + _U(1)) * power[place], starts)
            hashes.append(mixed(sums))
            starts_all.append(inside[starts] + at)
        at += len(piece)
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(np.concatenate(starts_all), ends, side="left")
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def weighted_shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of each distinct shingle of each text, ordered by text and hash."""
    words, counts = word_hashes(texts)
    factors = _odd(2, size)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        total[: len(words) - k] += words[k:] * factors[k]
    left = ends[of] - np.arange(len(words))  # words from here to the text's end
    whole = left >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    for t in short:
        first = ends[t] - counts[t]
        total[first] = (words[first : ends[t]] * factors[: counts[t]]).sum(dtype=np.uint64) + _U(int(counts[t]))
        whole[first] = True
    hashes, of = mixed(total[whole]), of[whole]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], hashes[at], np.diff(np.append(at, len(hashes))).astype(np.float64)


def probability_jaccard(x: np.ndarray, x_weight: np.ndarray, y: np.ndarray, y_weight: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets with sorted elements; 0 if one is empty."""
    common, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    only_x, only_y = x_weight.sum() - x_weight[at_x].sum(), y_weight.sum() - y_weight[at_y].sum()
    a, b = x_weight[at_x], y_weight[at_y]
    ratio = b / a
    found = 0.0
    for r in np.unique(ratio):
        found += a[ratio == r].sum() / (np.maximum(a, b / r).sum() + only_x + only_y / r)
    return float(found)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Plain Jaccard similarity of sorted distinct elements; 0 if one set is empty."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if common else 0.0


class Block:
    """Shingles of some texts, each text's sorted, to compare others with all of them at once."""

    def __init__(self, hashes: list[np.ndarray], weights: list[np.ndarray]):
        self.texts = list(zip(hashes, weights, strict=True))
        self.counts, self.totals = np.array([len(h) for h in hashes]), np.array([w.sum() for w in weights])
        every, of = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), self.counts)
        order = np.argsort(every, kind="stable")
        self.hashes, self.weights, self.of = every[order], np.concatenate(weights)[order], of[order]

    def alike(self, hashes: np.ndarray, weights: np.ndarray, threshold: float) -> list[int]:
        """Places of the texts whose plain Jaccard or probability Jaccard similarity to the given shingles reaches threshold."""
        low = np.searchsorted(self.hashes, hashes)
        counts = np.searchsorted(self.hashes, hashes, side="right") - low
        own = np.repeat(np.arange(len(hashes)), counts)
        at = np.arange(len(own)) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        of, size = self.of[at], len(self.counts)
        common = np.bincount(of, minlength=size)
        plain = common / np.maximum(len(hashes) + self.counts - common, 1)
        a = 1 - np.bincount(of, weights[own], size) / max(weights.sum(), 1)
        b = 1 - np.bincount(of, self.weights[at], size) / np.maximum(self.totals, 1)
        bound = (1 - a) * (1 - b) / np.maximum(1 - a * b, 1e-12)  # of the probability Jaccard similarity
        near = (plain >= threshold) | (bound >= threshold - 1e-6)
        return [j for j in np.flatnonzero(near).tolist() if plain[j] >= threshold or probability_jaccard(hashes, weights, *self.texts[j]) >= threshold]


def probminhash(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, texts x registers; rows of texts without shingles are 0.

    Each shingle is a Poisson process whose rate is its weight: arrivals come
    at exponential distances, each at a random register, which holds the
    shingle that arrived first. All first arrivals are taken before all second
    ones and so on. A shingle is done as soon as it is later than all registers
    of its text.
    """
    first = np.full(texts * registers, np.inf)
    owner = np.zeros(texts * registers, dtype=np.uint64)
    time, turn = np.zeros(len(hashes)), 0
    while len(hashes):
        chance = mixed(hashes ^ _U(0xA5A5_0000_0000 + turn))
        time = time - np.log(((chance >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        place = of * registers + (mixed(chance) % _U(registers)).astype(np.int64)
        better = np.flatnonzero(time < first[place])
        better = better[np.lexsort((hashes[better], time[better]))[::-1]]  # the earliest is written last
        first[place[better]] = time[better]
        owner[place[better]] = hashes[better]
        going = time < first.reshape(texts, registers).max(axis=1)[of]
        of, hashes, weights, time, turn = of[going], hashes[going], weights[going], time[going], turn + 1
    return owner.reshape(texts, registers)
