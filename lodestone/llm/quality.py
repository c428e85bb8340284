"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes for a document (+1), against it (-1) or abstains (0).  The votes of all documents are counted by
pattern (at most 3^RULES patterns reach the driver), expectation-maximisation over these counts estimates how often
each rule is right on good and on bad documents and how many documents are good, and a document's posterior
probability of being good replaces passing every rule.

The text measures are computed in one pass and written as a narrow table in the shared folder; the posterior is a sum
of log ratios over that table's votes.

Nulls and ties: a null text has no words, symbols or lines and fails the base rules; repeated rows get equal verdicts;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize

_SEPARATORS = " \t\n\x0b\x0c\r"
_SPACE = "[ \\t-\\r]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Before any vote is seen: the share of good documents, and how often a vote is right on a good document and on a bad
#: one (a rule looks for one fault of many, so most rules find nothing wrong with a bad document).
PRIOR, RIGHT_GOOD, RIGHT_BAD = 0.85, 0.95, 0.3
EM_ROUNDS = 200
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_other", "n_symbol_ends", "n_stops")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable, where an inlined column would be evaluated again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Window hashes are sorted with their positions, so equal windows are neighbours; the positions of repeated ones,
    sorted, each cover three words less the overlap with the next.
    """
    n = F.size(words)

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        same = F.filter(hashes, lambda x, i: (F.get(hashes, i - 1)["h"] == x["h"]) | (F.get(hashes, i + 1)["h"] == x["h"]))
        return _let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return _let(F.sort_array(hashed), repeated)

    return F.when(n < 3, F.lit(0)).otherwise(_let(words, windows)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the text measures of every document (whole texts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(_SEPARATORS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words.alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SEPARATORS)) != "").alias("lines"),
    )
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("\\p{Lu}").alias("n_upper"),
        count("[!?]").alias("n_marks"),
        count("[^\\p{L}\\x20\\x09-\\x0D]").alias("n_other"),
        count("[#*$%&|<>](?![^\\x20\\x09-\\x0D])").alias("n_symbol_ends"),
        count("[.!?:;][\\x20\\x09-\\x0D]|[.!?:;]$").alias("n_stops"),
    )


def rules() -> dict[str, Column]:
    """The votes: +1 good, -1 bad, 0 abstains, from the measures."""
    n = F.col("n_words")

    def two(bad: Column, good: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / n
    return {
        "length": two(n < 20, n >= 50),
        "symbols": two(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") <= 0.02 * n),
        "repetition": two(F.col("n_repeat_words") > 0.3 * n, F.col("n_repeat_words") <= 0.1 * n),
        "duplicate_lines": two(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_dup_lines") <= 0.1 * F.col("n_lines")),
        "capitals": two(F.col("n_upper") > 0.3 * F.col("word_chars"), F.col("n_upper") <= 0.1 * F.col("word_chars")),
        "word_length": two((mean < 2.5) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        "marks": two(F.col("n_marks") > 0.2 * n, F.col("n_marks") <= 0.05 * n),
        "letters": two(F.col("n_other") > 0.15 * F.col("word_chars"), F.col("n_other") <= 0.08 * F.col("word_chars")),
        "symbol_ends": two(F.col("n_symbol_ends") > 0.1 * n, F.col("n_symbol_ends") <= 0.02 * n),
        "sentences": two(F.col("n_stops") < 0.01 * n, F.col("n_stops") >= 0.03 * n),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, documents): the share of good documents, and per rule how often a vote is right on a good
    and on a bad document.  An abstention says nothing.  Counts are smoothed by one imagined document that agrees
    with the start values, so a rule that never votes keeps them and no estimate reaches 0 or 1."""
    if not patterns:
        return PRIOR, []
    votes, n = np.array([v for v, _ in patterns], float), np.array([n for _, n in patterns], float)
    prior, right = PRIOR, np.tile([RIGHT_GOOD, RIGHT_BAD], (votes.shape[1], 1))
    for _ in range(EM_ROUNDS):
        good = posteriors(votes, prior, right)
        now = float(((good * n).sum() + PRIOR) / (n.sum() + 1))
        fresh = np.empty_like(right)
        for k, (mass, side, start) in enumerate(((good * n, 1, RIGHT_GOOD), ((1 - good) * n, -1, RIGHT_BAD))):
            fresh[:, k] = (mass @ (votes == side) + start) / (mass @ (votes != 0) + 1)
        moved = abs(now - prior) + np.abs(fresh - right).sum()
        prior, right = now, fresh
        if moved < 1e-9:
            break
    return prior, [(float(g), float(b)) for g, b in right]


def posteriors(votes: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    """The probability of being good for each row of votes."""
    g, b = right[:, 0], right[:, 1]
    score = (votes > 0) @ np.log(g / (1 - b)) + (votes < 0) @ np.log((1 - g) / b) + math.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(score, -700, 700)))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every document's measures, votes, posterior ``quality`` and verdict ``kept``."""
    voted = measures(docs)
    names = [f"vote_{k}" for k in rules()]
    voted = materialize(voted.select("*", *(c.cast("int").alias(f"vote_{k}") for k, c in rules().items())), "quality-votes")
    patterns = sorted((tuple(r[c] for c in names), r["n"]) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 3^10 rows
    prior, right = fit(patterns)
    score = F.lit(math.log(prior / (1 - prior)))
    for c, (g, b) in zip(names, right):
        score = score + F.when(F.col(c) > 0, F.lit(math.log(g / (1 - b)))).when(F.col(c) < 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-score))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
