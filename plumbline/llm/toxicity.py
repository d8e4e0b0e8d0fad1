"""Toxicity as multiple-instance learning: a document is toxic if at least one of its sentences is.

Labels exist for documents only. A sentence's score is a logistic function of the marked words and word beginnings
in it, and a
document's score joins its sentences by noisy-or, ``1 - prod(1 - p)``. The weights are trained from document
labels alone; afterwards the same sentence scores say where the offending sentences are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, text_of

#: labelled documents that a model is fitted on, about; chosen by a hash of their text
SAMPLE = 20_000
#: words that carry a weight, the documents a word must occur in, and the deviations from chance it must show
FEATURES, SUPPORT, DEVIATIONS = 4096, 6, 4.0
#: weight of the squared weights in the loss per document
SHRINK = 1e-5

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*")


@dataclass(frozen=True)
class Model:
    """Weight of every marked word, and the log-odds of a sentence without any."""

    weights: dict[str, float]
    bias: float


def _features(words) -> set[str]:
    """Distinct words and their beginnings of four and five letters, which stand for a word's unseen forms."""
    distinct = set(words)
    return distinct | {f"{w[:n]}-" for w in distinct for n in (4, 5) if len(w) > n}


def _sentences(text: str, marked) -> tuple[int, list[tuple[int, int, list[str]]]]:
    """Number of sentences, and place and marked words (each once) of those that have any."""
    if not text:
        return 0, []
    low = text.lower()
    n = sum(1 for _ in _SENTENCE.finditer(text))
    if marked.isdisjoint(_features(_WORD.findall(low))):
        return n, []
    found = []
    for m in _SENTENCE.finditer(text):
        if words := marked.intersection(_features(_WORD.findall(m.group().lower()))):
            found.append((m.start(), m.end(), sorted(words)))
    return n, found


def _word_counts(sample: DataFrame) -> DataFrame:
    """Documents and toxic documents of every word and beginning, counted per batch before they are shuffled."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            docs, toxic = Counter(), Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = _features(_WORD.findall(text.lower()))
                docs.update(words)
                if y:
                    toxic.update(words)
            words = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([docs[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())],
                names=["word", "n", "t"],
            )

    return sample.mapInArrow(count, "word string, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _train(y: np.ndarray, plain: np.ndarray, bag: np.ndarray, entry: np.ndarray, feature: np.ndarray, width: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood. ``plain``: sentences without features of each document; ``bag``: document
    of each other sentence; ``entry`` and ``feature``: sentence and feature of every occurrence."""
    theta = np.r_[np.full(width, 1.0), -6.0]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(len(y), 1)
    for step in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(entry, w[feature], minlength=len(bag))
        q = -np.bincount(bag, np.logaddexp(0, z), minlength=len(y)) - plain * np.logaddexp(0, b)
        q = np.minimum(q, -1e-9)
        pull = np.where(y > 0, np.exp(q) / -np.expm1(q), -1.0)
        slope_z = -pull[bag] / (1 + np.exp(-z)) if len(bag) else np.zeros(0)
        grad_w = np.bincount(feature, slope_z[entry], minlength=width) / n + 2 * SHRINK * w
        grad_b = (slope_z.sum() - (pull * plain).sum() / (1 + np.exp(-b))) / n
        g = np.r_[grad_w, grad_b]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def with_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Documents with their label, about ``sample`` of them at most, chosen by a hash of the key among all labels.

    The chosen labels are bounded by the sample, so they go to the documents and no text is moved.
    """
    known = labels.filter(F.col(f"`{label}`").isNotNull()).select(key, label)
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    return docs.join(F.broadcast(known), key)


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from rows with a text and a 0/1 label; rows with a null label are left out, null texts are empty.

    At most about ``sample`` rows are used, chosen by a hash of the text, so the choice is the same in every run;
    what reaches the driver are the chosen words (at most ``FEATURES``) and, per sampled document, the marked
    words of its sentences. Without any label, or with one class only, no word is marked and every score is low.
    """
    rows = labelled.select(text_of(text).alias("text"), (F.col(f"`{label}`") > 0).cast("int").alias("y")).filter("y is not null")
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not toxic:
        return Model({}, -30.0)
    t, c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (toxic - F.col("t") + 0.5)) - F.log(c / (n - toxic - F.col("n") + F.col("t") + 0.5))
    strength = odds / F.sqrt(1 / t + 1 / c)
    words = (
        _word_counts(rows).filter(F.col("n") >= SUPPORT).withColumn("strength", strength)
        .filter(F.col("strength") >= DEVIATIONS).orderBy(F.desc("strength"), "word").limit(FEATURES)
    )
    index = {r["word"]: k for k, r in enumerate(words.collect())}
    marked = frozenset(index)

    def bags(batches):
        import pyarrow as pa

        for batch in batches:
            n, lists = [], []
            for one in batch.column("text").to_pylist():
                count, found = _sentences(one, marked)
                n.append(count - len(found))
                lists.append([[index[w] for w in words] for _, _, words in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int32())))], names=["y", "plain", "found"]
            )

    y, plain, bag, entry, feature = [], [], [], [], []
    for row in rows.mapInArrow(bags, "y int, plain long, found array<array<int>>").collect():
        for sentence in row["found"]:
            entry += [len(bag)] * len(sentence)
            feature += sentence
            bag.append(len(y))
        y.append(row["y"])
        plain.append(row["plain"])
    to = lambda x: np.array(x, dtype=np.int64)
    weights, bias = _train(to(y), to(plain), to(bag), to(entry), to(feature), len(index))
    return Model({w: float(weights[k]) for w, k in index.items()}, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``offending``, the sentences (start, end, score) that alone reach one half.

    Null and empty texts have no sentence and score 0. Rows stay as they are, repeated ones too; columns of the
    two names are replaced. The model has at most ``FEATURES`` words, so it travels with the tasks.
    """
    weights, bias, marked = model.weights, model.bias, frozenset(model.weights)
    # log(1 - p) of a sentence without marked words
    plain = -float(np.logaddexp(0, bias))

    @F.pandas_udf("score double, offending array<struct<start: int, end: int, score: double>>")
    def scored(texts):
        import pandas as pd

        values, spans = [], []
        for one in texts.tolist():
            n, found = _sentences(one, marked)
            none, places = plain * (n - len(found)), []
            for start, end, words in found:
                z = bias + sum(weights[w] for w in words)
                none -= float(np.logaddexp(0, z))
                if z >= 0:
                    places.append({"start": start, "end": end, "score": float(1 / (1 + np.exp(-z)))})
            values.append(float(-np.expm1(none)))
            spans.append(places)
        return pd.DataFrame({"score": values, "offending": spans})

    name = free_name(docs, "scored")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "offending")]
    return docs.select(*kept, scored(text_of(text)).alias(name)).select(*kept, f"{name}.score", f"{name}.offending")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether CRC-32 of the id as text leaves remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
