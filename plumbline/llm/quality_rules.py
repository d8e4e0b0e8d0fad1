"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measured property of a text and votes good (1), bad (-1) or abstains (0). The rows are
counted by vote pattern (at most 3 to the number of rules, so the table is small at any corpus size), EM on
that table estimates how often each rule votes what for good and for bad texts, and every document gets the
posterior probability of being good. Everything that touches documents is SQL expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bound, staged, text_of, words_of

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_marks", "n_distinct_words",
)


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text."""

    def covered(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            near = lambda k: F.get(s, k)["h"]
            twice = F.filter(s, lambda x, k: (x["h"].eqNullSafe(near(k - 1))) | (x["h"].eqNullSafe(near(k + 1))))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        # windows start at sorted places: each adds at most three words, fewer where it overlaps the one before
        def total(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))),
                F.lit(0),
                lambda a, x: a + x,
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(bound(tagged, places), total))

    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        )

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return bound(bound(hashes, windows), covered).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measured properties (``MEASURES``, all long) to every row; columns of these names are replaced.

    Null and empty texts measure 0 throughout. Windows are compared by a 64-bit hash within one text.
    """
    whole = text_of(text)
    spaced = docs.withColumns({"__t": whole, "__w": words_of(whole)})
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.size(F.split("__t", "[#*$%&|<>]", -1)) - 1,
        "n_lines": F.size(lines),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeat_words(F.col("__w")),
        "n_upper": F.size(F.split("__t", "\\p{Lu}", -1)) - 1,
        "n_marks": F.size(F.split("__t", "[!?]{2,}", -1)) - 1,
        "n_distinct_words": F.size(F.array_distinct("__w")),
    }
    return spaced.withColumns({k: v.cast("long") for k, v in out.items()}).drop("__t", "__w")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


#: the production rules, over the measured columns; each looks at another kind of defect, so that votes are
#: about independent given the class, as the estimate assumes
RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("symbols", "n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    Rule(
        "repetition",
        "n_repeat_words * 5 > n_words * 2 or (n_lines > 3 and n_dup_lines * 10 > n_lines * 3)"
        " or (n_words between 50 and 2000 and n_distinct_words * 6 < n_words)",
        "n_repeat_words * 5 <= n_words and n_dup_lines * 10 <= n_lines",
    ),
    Rule("shouting", "n_upper * 10 > word_chars * 3 or n_marks * 10 > n_words", "n_upper * 10 <= word_chars and n_marks * 100 <= n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
)

#: texts that no vote can save
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

#: what is presumed of a rule's accuracy: on good texts it rarely votes bad, and as every rule knows one kind of
#: defect only, it finds at most about a third of the bad texts
GOOD_ACCURACY, BAD_ACCURACY = (0.995, 0.9999), (0.05, 0.35)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for two hidden classes: the share of good texts and every rule's accuracy on good and on bad texts.

    An abstaining rule says nothing. The start is "good unless a rule votes bad"; accuracies stay within their
    presumed ranges, which also settles which class is the good one.
    """
    good = np.where((patterns < 0).any(axis=1), 0.02, 0.99)
    for_, against = (patterns > 0).astype(float), (patterns < 0).astype(float)
    share, on_good, on_bad = 0.5, np.full(patterns.shape[1], GOOD_ACCURACY[0]), np.full(patterns.shape[1], BAD_ACCURACY[1])
    for _ in range(rounds):
        w1, w0 = counts * good, counts * (1 - good)
        share = float((w1.sum() + 1) / (counts.sum() + 2))
        on_good = np.clip((w1 @ for_ + 1) / (w1 @ (for_ + against) + 1), *GOOD_ACCURACY)
        on_bad = np.clip((w0 @ against + 0.5) / (w0 @ (for_ + against) + 1), *BAD_ACCURACY)
        odds = np.log(share / (1 - share)) + for_ @ np.log(on_good / (1 - on_bad)) + against @ np.log((1 - on_good) / on_bad)
        good = 1 / (1 + np.exp(-odds))
    return share, on_good, on_bad


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, store: bool = True) -> DataFrame:
    """Adds ``quality`` (posterior probability of good), ``base_failed`` and ``kept`` to measured rows.

    Kept is what does not fail the base and has ``quality >= threshold``.
    The estimate and the verdict both need the measures. With ``store`` the rows are written once to the shared
    folder in between, which suits rows without their texts; otherwise texts are measured twice and nothing is
    moved or written. Rows with equal measures get equal verdicts; an empty table stays empty.
    """
    votes = {f"__v{i}": F.expr(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end") for i, r in enumerate(rules)}
    voted = measured.withColumns(votes)
    voted = staged(voted, "quality-votes") if store else voted
    table = voted.groupBy(*votes).count().collect()  # at most 3 ** len(rules) rows
    patterns = np.array([[r[v] for v in votes] for r in table], dtype=int).reshape(len(table), len(rules))
    share, on_good, on_bad = estimate(patterns, np.array([r["count"] for r in table], dtype=float))
    odds = F.lit(float(np.log(share / (1 - share))))
    for v, g, b in zip(votes, on_good.tolist(), on_bad.tolist(), strict=True):
        odds = odds + F.when(F.col(v) < 0, float(np.log((1 - g) / b))).when(F.col(v) > 0, float(np.log(g / (1 - b)))).otherwise(0.0)
    judged = voted.withColumns({"quality": 1 / (1 + F.exp(-odds)), "base_failed": F.expr(BASE_FAILED)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*votes)


def filter_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose posterior quality reaches the threshold, with the columns they came with."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    judged = judge(measure(inner, f"c{names.index(text)}"), threshold=threshold, store=False)
    return judged.filter("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
