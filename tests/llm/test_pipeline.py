"""The pipeline from end to end, against its stages done by brute force."""

import itertools
import random
import re

import numpy as np
import corpus_pipeline
from papyra.llm import packing, pii, quality
from papyra.llm.queries import pii_secret

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def documents(rng):
    """Good texts with near and exact copies, junk, personal data, nulls and rows that repeat."""
    def good(k):
        word = lambda: rng.choice(("the", "of", "and", "to", "with", "".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randrange(3, 9)))))
        return "\n".join(f"{k} " + " ".join(word() for _ in range(rng.randrange(8, 18))) + "." for _ in range(15))

    texts = []
    for k in range(60):
        text = good(k)
        texts += [text] + [text] * (k % 4 == 0)
        if k % 3 == 0:
            texts.append(text + " one more word")
        if k % 5 == 0:
            texts.append(text.replace(" the ", " a ", 1))
        if k % 7 == 0:
            texts.append(f"{text}\nMr John Smith, js{k}@mail.example, {text[:40]}")
    texts += ["#" * 400, None, "", "short", good("long") * 40]
    rng.shuffle(texts)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[:5] + [(None, good("null key"), None, None, 5)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or [" ".join(words)] * bool(words)
    return {s: 1 + np.log(runs.count(s)) for s in set(runs)}


def alike(a, b):
    """The greater of the plain and the probability Jaccard similarity."""
    common = a.keys() & b.keys()
    plain = len(common) / len(a.keys() | b.keys())
    p, q = sum(a.values()), sum(b.values())
    weighted = 0.0
    for s in common:
        x, y = a[s] / p, b[s] / q
        weighted += 1 / sum(max(a.get(t, 0) / p / x, b.get(t, 0) / q / y) for t in a.keys() | b.keys())
    return max(plain, weighted)


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    rows = documents(random.Random(21))
    sf_dir = folder(spark, tmp_path, rows)
    verdict = quality.judge(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string")).where("kept").collect()
    kept = [rows[r.doc_id] for r in verdict]
    texts = sorted({r[1] for r in kept})
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if label[i] != label[j] and sets[i].keys() & sets[j].keys() and alike(sets[i], sets[j]) >= 0.8:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    classes = {}
    for r in kept:
        classes.setdefault(label[texts.index(r[1])], []).append(r)
    want = {}
    for members in classes.values():
        least = min((r[0] is None, r[0] or 0) for r in members)
        want[None if least[0] else least[1]] = {pii.replaced(r[1], pii._key(pii_secret(spark)))[0] for r in members if (r[0] is None, r[0] or 0) == least}
    got = corpus_pipeline.run(spark, sf_dir)
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert pieces.keys() == want.keys() and 50 < len(want) < 70
    for key, texts in want.items():
        packed = packing.pack_documents(spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")) if key in (min(k for k in want if k is not None), None) else None
        if packed is not None:
            assert any(sorted(pieces[key]) == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()) for _ in (0,))
    filled = {}
    for r in got.collect():
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(parts[-1]) <= 2048


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [])).count() == 0
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (3, "word " * 20_000, "en", "s", 100_000)]
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "odd", odd)).count() == 0


def test_no_stage_stays_once_the_next_is_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark, prefix: f"file://{tmp_path}/shared")
    corpus_pipeline.run(spark, folder(spark, tmp_path / "in", documents(random.Random(3))[:40]))
    (stages,) = (tmp_path / "shared").iterdir()
    assert [p.name for p in stages.iterdir()] == ["3"]

