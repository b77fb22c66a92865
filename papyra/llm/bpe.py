"""BPE encoding and decoding of a tokenizer file, from its vocabulary and merges.

The symbols of a pre-token form a doubly linked list; a priority queue holds
(rank, place) of every adjacent pair that has a merge. A popped entry whose
pair has changed since is stale and skipped. Decoding joins vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from papyra.llm.common import map_batches, out

#: What \s of the tokenizer files means: Unicode's White_Space. str.split() also splits at U+001C to U+001F.
SPACES = "\t-\r \x85\xa0  -     　"
_SPACES, _ODD = re.compile(f"[{SPACES}]+"), re.compile("[\x1c-\x1f]")
#: Entries of a worker's cache of some 200 bytes each, and the length in characters above which nothing is kept.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 48
#: Above which a text is not encoded together with others.
LONG_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    """A name is looked up among the public tokenizers, anything with a slash is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    """The library's tokenizer of the file, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(name))
    found.no_truncation()
    found.no_padding()
    return found


def chunks_of(text: str) -> list[str]:
    """The text's runs without white space."""
    return [c for c in _SPACES.split(text) if c] if _ODD.search(text) else text.split()


class Cache(dict):
    """make(key) of every key asked for. When full it keeps its older half: frequent keys come early, most later ones are rare."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES, chars: int = CACHE_CHARS):
        super().__init__()
        self.make, self.entries, self.chars = make, entries, chars

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= self.entries:
                kept = list(islice(self.items(), self.entries // 2))
                self.clear()
                self.update(kept)
            self[key] = value
        return value


def _flat(step: dict | None, inner: str) -> list[dict]:
    """The steps of a part of a tokenizer file."""
    return [x for s in step[inner] for x in _flat(s, inner)] if step and step["type"] == "Sequence" else [step] * bool(step)


#: Runs of what _for_latin() knows: printable ASCII and the letters from U+00C0 to U+00FF.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")


def _for_latin(pattern: str) -> str:
    """A pattern of the tokenizer files for such texts, which the faster standard library understands."""
    found, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        letters = {r"\p{L}": "a-zA-ZÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9"}.get(part)
        if part.startswith(r"\p{") and letters is None:
            raise ValueError(f"{part}: not supported")
        inside = part == "[" or inside and part != "]"
        found.append(part if letters is None else letters if inside else f"[{letters}]")
    return "".join(found)


#: Steps of normalising that leave runs of _LATIN as they are, but for the case of letters, and join no runs.
_NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})


def _demand_known(name: str, spec: dict) -> None:
    """ValueError for a file whose normalising or special tokens are of kinds that would get other ids here than by the library."""
    for step in _flat(spec["normalizer"], "normalizers"):
        if step not in _NORMALIZERS:
            raise ValueError(f"{name}: normalizer {step['type']} is not supported")
    for token in spec["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"] or "<|" not in token["content"] or _SPACES.search(token["content"]):
            raise ValueError(f"{name}: special token {token['content']} is not supported")


class Bpe:
    """Encoder of a BPE file whose pre-tokens never hold white space, so that the runs between it are encoded one by one."""

    def __init__(self, name: str):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or model["unk_token"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{name}: not a file of the supported kind")
        _demand_known(name, spec)
        self.library = library(name)
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names = {v: k for k, v in (self.vocab | self.specials).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        split, *others = [p for p in _flat(spec["pre_tokenizer"], "pretokenizers") if p["type"] != "ByteLevel"] or [{}]
        if others or split.get("type") != "Split" or not split["invert"] or split["behavior"] != "Removed" or "Regex" not in split["pattern"]:
            raise ValueError(f"{name}: not a file of the supported kind")
        #: For runs of printable ASCII and the letters of Latin-1, which no other normalizer than this changes.
        self.plain = re.compile(_for_latin(split["pattern"]["Regex"]), re.ASCII)
        self.bytes = {ord(c): self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if c.isalpha()}
        self.lower = any(n["type"] == "Lowercase" for n in _flat(spec["normalizer"], "normalizers"))
        self.words = Cache(self.merged, CACHE_ENTRIES // 2)
        self.chunks = Cache(self.chunk)
        self.texts = Cache(self.chunk_text)

    def merged(self, word: str) -> bytes:
        """Ids of a pre-token, as little-endian 32-bit integers."""
        vocab, merges = self.vocab, self.merges
        symbols = [vocab[c] for c in word[:-1]]
        symbols.append(vocab[word[-1] + self.end])
        count = len(symbols)
        if count == 1:
            return struct.pack("<I", symbols[0])
        shift, mask = count.bit_length(), (1 << count.bit_length()) - 1
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        queue = []
        for i in range(count - 1):
            merge = merges.get((symbols[i], symbols[i + 1]))
            if merge:
                queue.append(merge[0] << shift | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & mask
            j = after[i]
            if j < 0 or symbols[i] < 0:
                continue
            merge = merges.get((symbols[i], symbols[j]))
            if merge is None or merge[0] != entry >> shift:
                continue  # stale
            symbols[i], symbols[j] = merge[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                merge = merges.get((symbols[i], symbols[k]))
                if merge:
                    heapq.heappush(queue, merge[0] << shift | i)
            k = before[i]
            if k >= 0:
                merge = merges.get((symbols[k], symbols[i]))
                if merge:
                    heapq.heappush(queue, merge[0] << shift | k)
        ids = [s for s in symbols if s >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def pretokens(self, chunk: str) -> list[str]:
        """Normalised and split as the file says, in its byte alphabet."""
        if _LATIN.fullmatch(chunk):
            found = self.plain.findall(chunk.lower() if self.lower else chunk)
            return found if chunk.isascii() else [w.translate(self.bytes) for w in found]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        if not self.special or "<|" not in chunk:
            return b"".join(map(self.words.__getitem__, self.pretokens(chunk)))
        parts = [p for p in self.special.split(chunk) if p]
        return b"".join(struct.pack("<I", self.specials[p]) if p in self.specials else b"".join(map(self.words.__getitem__, self.pretokens(p))) for p in parts)

    def chunk_text(self, chunk: str) -> str:
        return self.decode(struct.unpack(f"<{len(b := self.chunks[chunk]) // 4}I", b))

    def decode(self, ids) -> str:
        """As the library does where a file names no decoder: vocabulary strings with a space between."""
        return " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, chunks_of(text)))

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """encode(text), and decode() of these ids, put together from its runs. A run may have no ids, as where normalising leaves nothing of it."""
        chunks = chunks_of(text)
        return b"".join(map(self.chunks.__getitem__, chunks)), " ".join([t for t in map(self.texts.__getitem__, chunks) if t])


class LibraryBpe(Bpe):
    """The same ids, but the library's own model merges the pre-tokens; for operators whose method is not the encoding."""

    def __init__(self, name: str):
        super().__init__(name)
        self.model = self.library.model

    def merged(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each text of a string array, null as empty: each distinct run of the array is looked up once."""
        texts = pc.fill_null(texts, "")
        alone = pc.or_(pc.greater(pc.binary_length(texts), LONG_BYTES), pc.match_substring_regex(texts, "[\x1c-\x1f]"))
        runs = pc.utf8_split_whitespace(pc.if_else(alone, "", texts))
        distinct = pc.dictionary_encode(runs.flatten())
        ids = [self.chunks[c] if c else b"" for c in distinct.dictionary.to_pylist()]
        table, sizes = np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(b) // 4 for b in ids], dtype=np.int64)
        of = distinct.indices.to_numpy()
        counts = sizes[of]
        ends = np.concatenate([[0], np.cumsum(counts)])
        firsts = (np.cumsum(sizes) - sizes)[of] - ends[:-1]
        every = table[np.arange(ends[-1]) + np.repeat(firsts, counts)]
        cuts = ends[runs.offsets.to_numpy() - runs.offsets[0].as_py()]
        for i, single in enumerate(alone.to_pylist()):
            yield self.encode(texts[i].as_py()) if single else every[cuts[i] : cuts[i + 1]].tobytes()


@lru_cache(maxsize=2)
def library_bpe(name: str) -> LibraryBpe:
    """One encoder, with its caches, for all tasks of a worker."""
    return LibraryBpe(name)


@lru_cache(maxsize=2)
def bpe(name: str) -> Bpe:
    """One encoder, with its caches, for all tasks of a worker."""
    return Bpe(name)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", keep: bool = True) -> DataFrame:
    """One row per row of df: key, n_tokens, ids_sha256, decoded_sha256, and with keep also ids (little-endian 32-bit) and decoded.

    Null texts count as empty: no ids, nothing decoded. Strings of special
    tokens inside texts give their ids, as by default in the library. Texts are
    read whole, whatever their length; repeated rows stay, an empty table gives
    an empty one, further columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        for batch in batches:
            counts, digests, decoded_digests, ids, texts = [], [], [], [], []
            for value in batch.column(1):
                encoded, decoded = coder.encode_decode(value.as_py() or "")
                counts.append(len(encoded) // 4)
                digests.append(hashlib.sha256(encoded).hexdigest())
                decoded_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    ids.append(encoded)
                    texts.append(decoded)
            yield out([key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep], [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string()), *[pa.array(ids, pa.binary()), pa.array(texts, pa.string())] * keep])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(df.select(key, text), run, schema + ", ids binary, decoded string" * keep)
