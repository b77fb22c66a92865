"""Toxicity scores by a classifier that is regularised by counterfactuals.

A logistic model over the words that a text has. Besides fitting the labels it is
to be indifferent to who is spoken of: in each sentence of the labelled texts that
names a group, the name gives way to those of other groups of its kind and to a
neutral word, and the change of the sentence's score is penalised. So that a word
is no sign of toxicity because groups are named where they are abused.

The model is fitted on a bounded sample of the labelled rows, by hash of the key
over all of them; its weights are a few hundred words, and each task scores its
texts by them. Labels, language, source and key are no features.

Defined cases: a null text is an empty one and has the score of a text without any
known word; labels that are null or contradict each other teach nothing; of rows
with one key one text teaches; each of repeated rows is scored; without labels of
both kinds every score is next to 1 if there are toxic ones only, else next to 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import checkpointed, map_batches, out

WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
#: Groups of people by kind, in several languages; what stands for any of them is first.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys", "ladies", "mothers", "fathers"),
    ("person", "woman", "man", "girl", "boy", "lady", "mother", "father"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"),
    ("human", "muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"),
    ("people", "africans", "americans", "arabs", "asians", "europeans", "mexicans", "indians", "immigrants", "refugees"),
    ("human", "black", "white", "african", "american", "arab", "asian", "european", "mexican", "indian", "immigrant", "refugee"),
    ("human", "gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("human", "disabled", "blind", "deaf", "autistic", "elderly"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "türken"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "arabes", "africains"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "árabes", "gitanos"),
)
KINDS = {term: kind for kind in IDENTITIES for term in kind[1:]}


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows to fit on, about; longest: distinct words of a text beyond which it does not teach; least_texts: in which a word must be; least_sign: standard errors of its log odds from none; lasso, ridge and counterfactual: strengths of the penalties."""

    sample: int = 20_000
    longest: int = 2_000
    least_texts: int = 5
    least_sign: float = 3.0
    lasso: float = 1e-3
    ridge: float = 1e-5
    counterfactual: float = 10.0
    rounds: int = 250


@dataclass(frozen=True)
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str]) -> np.ndarray:
        weights = self.weights
        found = [self.bias + sum(weights[w] for w in sorted(weights.keys() & set(WORD.findall(t.lower())))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(found, -700, 700)))


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5


def identity_sentences(text: str) -> list[str]:
    """Of each sentence that names groups these names, in order, with blanks between."""
    if not any(w in KINDS for w in set(WORD.findall(text))):
        return []
    found = (sorted({w for w in WORD.findall(s) if w in KINDS}) for s in SENTENCE_END.split(text))
    return [" ".join(terms) for terms in found if terms]


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """toxic, words (distinct) and named (identity_sentences()) of the rows to learn from: keys of folds but 0."""
    agreed = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).groupBy(key).agg(F.min(label).alias("toxic"), F.max(label).alias("__most"))
    agreed = checkpointed(agreed.where("toxic = __most").select(F.col(key).alias("__key"), "toxic"))
    share = settings.sample / max(agreed.count(), 1)
    ids = agreed if share >= 1 else agreed.where(F.pmod(F.xxhash64("__key"), F.lit(1 << 32)) < int(share * (1 << 32)))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(ids), "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [(t.as_py() or "").lower() for t in batch["__text"]]
            words = [sorted(set(WORD.findall(t))) for t in low]
            kept = [i for i, w in enumerate(words) if len(w) <= settings.longest]
            names = [identity_sentences(low[i]) for i in kept]
            yield out(["__key", "toxic", "words", "named"], [batch["__key"].take(pa.array(kept, pa.int64())), batch["toxic"].take(pa.array(kept, pa.int64())), pa.array([words[i] for i in kept], pa.list_(pa.string())), pa.array(names, pa.list_(pa.string()))])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = map_batches(rows, run, f"__key {kinds['__key']}, toxic {kinds['toxic']}, words array<string>, named array<string>")
    one = found.groupBy("__key").agg(F.min_by(F.struct("toxic", "words", "named"), F.struct(F.xxhash64("words"), "named")).alias("row"))
    return one.select("row.*")


def swaps(named: Counter[str]) -> list[tuple[dict[str, int], int]]:
    """Changes of a sentence's words and how often: its names against those of others of their kinds, in order, the neutral word among them."""
    found = []
    for sentence, times in named.items():
        terms = sentence.split(" ")
        for shift in range(max(len(KINDS[t]) for t in terms)):
            change: Counter[str] = Counter()
            for term in terms:
                kind = KINDS[term]
                change[term] += 1
                change[kind[shift % len(kind)]] -= 1
            if change := {w: n for w, n in change.items() if n}:
                found.append((change, times))
    return found


def fit(words: pa.ListArray, toxic: np.ndarray, named: Counter[str], settings: Settings = Settings()) -> Model:
    """Weights by gradient steps with momentum: once with all penalties, then once more without the lasso for the words that it left."""
    positive = int(toxic.sum())
    if not 0 < positive < len(toxic):
        return Model(700.0 if positive else -700.0)
    coded = words.flatten().dictionary_encode()
    at, names = coded.indices.to_numpy(), np.array(coded.dictionary.to_pylist(), dtype=object)
    rows = np.repeat(np.arange(len(toxic)), words.value_lengths().to_numpy())
    inside = np.bincount(at, weights=toxic[rows], minlength=len(names))
    outside = np.bincount(at, minlength=len(names)) - inside
    total = (len(toxic) - positive, positive)
    odds = np.log((inside + 0.5) / (total[1] - inside + 0.5)) - np.log((outside + 0.5) / (total[0] - outside + 0.5))
    error = np.sqrt(1 / (inside + 0.5) + 1 / (total[1] - inside + 0.5) + 1 / (outside + 0.5) + 1 / (total[0] - outside + 0.5))
    chosen = np.flatnonzero((inside + outside >= settings.least_texts) & (np.abs(odds) >= settings.least_sign * error))
    chosen = chosen[np.argsort(names[chosen])]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[at] >= 0
    at, rows, vocabulary = place[at][keep], rows[keep], list(names[chosen])
    known = {w: i for i, w in enumerate(vocabulary)}
    changes = [([known[w] for w in c if w in known], [n for w, n in c.items() if w in known], m) for c, m in swaps(named)]
    changes = [(np.array(i), np.array(n, float), float(m)) for i, n, m in changes if i]
    share = settings.counterfactual / max(sum(m for _, _, m in changes), 1.0)
    n, size = len(toxic), len(vocabulary)
    # Each kind of row counts as the mean of its own share and a half.
    costs = np.where(toxic > 0, 0.5 + n / positive / 4, 0.5 + n / (n - positive) / 4) / n
    costs /= costs.sum()

    def descend(start: np.ndarray, lasso: float, free: np.ndarray) -> np.ndarray:
        """From start, weights outside of free held at 0."""
        ahead, last, pace = start.copy(), start, 1.0
        # The steepest that the loss and the swaps can be.
        reach = 0.25 * _largest(at, rows, costs, size) + settings.ridge + 2 * share * sum(m * float(c @ c) for _, c, m in changes)
        for _ in range(settings.rounds):
            logits = np.bincount(rows, weights=ahead[at], minlength=n) + ahead[size]
            missed = (1 / (1 + np.exp(-logits)) - toxic) * costs
            slope = np.append(np.bincount(at, weights=missed[rows], minlength=size), missed.sum())
            slope[:size] += settings.ridge * ahead[:size]
            for i, c, m in changes:
                slope[i] += 2 * share * m * float(ahead[i] @ c) * c
            new = ahead - slope / reach
            new[:size] = np.sign(new[:size]) * np.maximum(np.abs(new[:size]) - lasso / reach, 0) * free
            if (ahead - new) @ (new - last) > 0:
                pace = 1.0
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead = new + (pace - 1) / faster * (new - last)
            last, pace = new, faster
        return last

    none = np.append(np.zeros(size), np.log(positive / (n - positive)))
    few = descend(none, settings.lasso, np.ones(size))
    held = few[at] != 0
    at, rows = at[held], rows[held]
    found = descend(few, 0.0, few[:size] != 0)
    return Model(float(found[size]), {w: float(x) for w, x in zip(vocabulary, found[:size], strict=True) if x})


def _largest(at: np.ndarray, rows: np.ndarray, costs: np.ndarray, size: int) -> float:
    """A little over the largest eigenvalue of the sum of the rows' products with themselves, by power iteration."""
    v, found = np.ones(size + 1), 1.0
    for _ in range(30):
        v /= np.linalg.norm(v)
        seen = (np.bincount(rows, weights=v[at], minlength=len(costs)) + v[size]) * costs
        v = np.append(np.bincount(at, weights=seen[rows], minlength=size), seen.sum())
        found = float(np.linalg.norm(v))
    return 1.05 * found


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    table = labelled(docs, labels, settings, key, text, label).toArrow().combine_chunks()
    words = pa.array([], pa.list_(pa.string())) if not table.num_rows else table["words"].combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    named = Counter(s for sentences in table["named"].to_pylist() for s in sentences)
    return fit(words, table["toxic"].to_numpy().astype(float), named, settings)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out (its fold is 0), score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([t.as_py() or "" for t in batch.column(2)])
            yield out([key, "held_out", "score", "predicted"], [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))])

    rows = docs.select(F.col(key), F.coalesce(fold(F.col(key)) == 0, F.lit(False)).alias("held_out"), F.col(text))
    return map_batches(rows, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores of all docs by a model of the labels."""
    return score(docs, learn(docs, labels, settings))
