"""Quality by weak supervision: rules vote good or bad or abstain, their votes are weighed by accuracies that expectation-maximisation estimates.

The features and votes are column expressions. The model sees only how often
each pattern of votes occurs, over all documents: 3 to the power of the number
of rules at most, which is what comes to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import checkpointed, text_or_empty
from papyra.llm.words import words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marked_words and n_distinct_words of a text column without nulls."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__words": words(F.col(text)), "__lines": lines, "n_symbols": F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long")})
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_marked_words": F.when(F.col("n_symbols") == 0, 0).otherwise(F.size(F.filter("__words", lambda w: w.rlike(SYMBOLS)))).cast("long"),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__lines", "__words")
    # Hashes of all windows, and for the few texts where some occur twice their places in order.
    windows = F.when(F.size("__hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({"__windows": windows, "n_distinct_words": F.size(F.array_distinct("__hashes")).cast("long")}).drop("__hashes")
    sorted_windows = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), sorted_windows)).drop("__windows")
    twice = F.filter("__sorted", lambda x, i: (F.get("__sorted", i - 1)["h"] == x["h"]) | (F.get("__sorted", i + 1)["h"] == x["h"]))
    df = df.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("__sorted")
    # Each such window adds as many words as lie before the next one begins.
    covered = F.transform("__places", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", i + 1) - at, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__places")


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the features, for either engine; neither: the rule abstains."""

    name: str
    bad: str
    good: str = "FALSE"


#: Shares are compared in whole numbers, so that every engine votes alike.
RULES = (
    Rule("symbols_per_word", "10 * n_symbols > n_words", "50 * n_symbols <= n_words AND n_words >= 20"),
    Rule("marked_words", "10 * n_marked_words > n_words"),
    Rule("symbols_per_char", "50 * n_symbols > word_chars"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words AND n_words >= 20"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("few_distinct_words", "n_words >= 100 AND 8 * n_distinct_words < n_words"),
    Rule("too_short", "n_words < 20"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND n_words >= 20"),
)
#: Base rules: too few words, or over 30 % of the words in repeated windows.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class Model:
    """Share of good documents, and of each rule the chance of a vote (bad, abstained, good) on a good and on a bad document."""

    good: float
    chances: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def weights(self) -> list[list[float]]:
        """Of each rule and vote: log odds that it adds. A vote for bad never speaks for good, nor the other way round."""
        found = []
        for good, bad in self.chances:
            w = [math.log(g / b) for g, b in zip(good, bad, strict=True)]
            found.append([min(w[0], 0.0), w[1], max(w[2], 0.0)])
        return found

    def prior(self) -> float:
        return math.log(self.good / (1 - self.good))

    def posterior(self, votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-self.prior() - sum(w[v + 1] for w, v in zip(self.weights(), votes, strict=True))))


#: Rounds of expectation-maximisation; before the first, the good share and each rule's chances, which say what a vote means.
ROUNDS, START_GOOD, START = 15, 0.8, ((0.02, 0.28, 0.7), (0.4, 0.3, 0.3))


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the counts of vote patterns, one of each vote added; what it starts from for a table without rows."""
    rules = len(next(iter(patterns), ()))
    model = Model(START_GOOD, (START,) * rules)
    for _ in range(rounds if patterns else 0):
        believed = [(votes, count * (p := model.posterior(votes)), count * (1 - p)) for votes, count in sorted(patterns.items())]
        totals = sum(g for _, g, _ in believed), sum(b for _, _, b in believed)
        chances = tuple(tuple(tuple((1 + sum(x[1 + side] for x in believed if x[0][k] == vote)) / (3 + totals[side]) for vote in (-1, 0, 1)) for side in (0, 1)) for k in range(rules))
        model = Model((1 + totals[0]) / (2 + sum(totals)), chances)
    return model


def _vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


def _voted(df: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]]:
    """df, which has a column text without nulls, with the features and votes in its place, and the names of the votes."""
    votes = [f"__vote{i}" for i in range(len(rules))]
    return with_features(df).drop("text").withColumns({v: _vote(r).cast("int") for v, r in zip(votes, rules, strict=True)}), votes


def _fitted(found: DataFrame, votes: list[str]) -> Model:
    patterns = found.groupBy(*votes).count().collect()
    return fit({tuple(r)[:-1]: r[-1] for r in patterns} or {(0,) * len(votes): 0})


def _judged(found: DataFrame, votes: list[str], model: Model) -> DataFrame:
    odds = F.lit(model.prior())
    for v, w in zip(votes, model.weights(), strict=True):
        odds = odds + F.get(F.array(*map(F.lit, w)), F.col(v) + 1)
    found = found.withColumns({"base_failed": F.expr(BASE_FAILED), "quality": 1 / (1 + F.exp(-odds))})
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("quality") > 0.5)).drop(*votes)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of df: key, the features, base_failed, quality (posterior probability of a good document) and kept.

    Null texts count as empty: all counts 0, and base_failed. Repeated rows
    stay and count as often; an empty table gives an empty one; further columns
    are not read. Features and votes are checkpointed, texts are not.
    """
    found, votes = _voted(df.select(key, text_or_empty(text).alias("text")), rules)
    found = checkpointed(found)
    return _judged(found, votes, _fitted(found, votes))


def kept_rows(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that judge() keeps, all their columns as they are.

    A row is judged where it lies: texts are neither shuffled nor written, but looked
    at twice, for the model and for the verdict. Null texts count as empty, repeated
    rows have one verdict, columns may have any names, an empty table stays empty.
    """
    model = _fitted(*_voted(df.select(text_or_empty(text).alias("text")), rules))
    found, votes = _voted(df.select(F.struct("*").alias("__row"), text_or_empty(text).alias("text")), rules)
    return _judged(found, votes, model).select(F.inline(F.when(F.col("kept"), F.array("__row"))))


def sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> str:
    """The contract's columns in DuckDB SQL, with the rounds of expectation-maximisation written out."""
    n = len(rules)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{k}" for k, r in enumerate(rules))
    names = {-1: "b", 0: "n", 1: "g"}
    weight = {-1: "least(ln({x}g / {x}b), 0)", 0: "ln({x}g / {x}b)", 1: "greatest(ln({x}g / {x}b), 0)"}
    odds = "ln(good / (1 - good)) + " + " + ".join(f"CASE v{k} " + " ".join(f"WHEN {v} THEN {weight[v].format(x=f'{names[v]}{k}')}" for v in names) + " END" for k in range(n))
    starts = ", ".join(f"{START[side][v + 1]} AS {names[v]}{k}{'gb'[side]}" for k in range(n) for side in (0, 1) for v in names)
    steps = [f"m0 AS (SELECT {START_GOOD} AS good, {starts})"]
    for i in range(rounds):
        updates = ", ".join(f"(1 + coalesce(sum({share}) FILTER (v{k} = {v}), 0)) / (3 + sum({share})) AS {names[v]}{k}{side}" for k in range(n) for side, share in (("g", "c * p"), ("b", "c * (1 - p)")) for v in names)
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT (1 + sum(c * p)) / (2 + sum(c)) AS good, {updates} FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM patterns, m{i}))")
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols FROM texts
), starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split WHERE len(words) >= {WINDOW}
), grams AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g FROM starts
), twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeats AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id
), features AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars, n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: regexp_matches(w, '{SYMBOLS}'))) AS n_marked_words, len(list_distinct(words)) AS n_distinct_words
  FROM split LEFT JOIN repeats USING (doc_id)
), voted AS MATERIALIZED (SELECT *, {votes} FROM features),
patterns AS MATERIALIZED (SELECT {', '.join(f'v{k}' for k in range(n))}, count(*) AS c FROM voted GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND {odds} > 0 AS kept
FROM voted, m{rounds}"""
