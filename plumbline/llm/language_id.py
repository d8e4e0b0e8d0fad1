"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes a space, runs of spaces become one, and its n-grams of one to
three characters are hashed into ``BUCKETS`` features. A feature's value is its share of the text's n-grams times its
inverse document frequency, scaled to be about one for a feature that matters. Document frequencies are counted with
Spark over all learnable rows; the classifier itself is fitted on a bounded sample of them, per language by a hash,
with follow-the-regularised-leader: each weight is solved from its summed gradients, and its L1 part leaves most
weights at exactly zero, the L2 part keeps the others small. A part of the sample is kept from training; on it one
temperature is found that makes the probabilities honest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, slices, text_of

#: documents that the classifier is fitted on, about; languages share them evenly as far as they have so many
SAMPLE = 6_000
#: hashed features, a power of two
BUCKETS = 1 << 18
#: characters of the longest n-grams
LONGEST = 3
#: rounds over the sample, and one of how many documents calibrates the temperature
ROUNDS, CALIBRATE = 3, 5
#: follow-the-regularised-leader: learning rate and its offset, weights of the absolute and the squared weights
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
#: what a feature's share of the text is multiplied by before its inverse document frequency
SCALE = 30.0

UNKNOWN = "und"
#: odd numbers that spread the characters of an n-gram
_ODD = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 where it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            out[k] = ord(c.lower()[0])
    return out


def _grams(text: str) -> np.ndarray:
    """The features of all n-grams in order of length and place; none for a text without a letter."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if not c.any():
        return np.zeros(0, dtype=np.int64)
    parts, mixed = [c[1:-1][c[1:-1] != 0] * _ODD[0]], c * _ODD[0]
    for n in range(2, LONGEST + 1):
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _ODD[1] + c[n - 1 :] * _ODD[2]
        parts.append(mixed)
    whole = np.concatenate(parts)
    return ((whole ^ (whole >> np.uint32(13))) * _ODD[1] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _distinct(grams: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each feature once; ``place`` is scratch space with a number per feature."""
    at = np.arange(len(grams), dtype=place.dtype)
    place[grams] = at
    return grams[place[grams] == at]


@dataclass(frozen=True)
class Model:
    """Languages, the weights of the features that have any (by sorted feature), the biases and the temperature.

    Weights already hold the inverse document frequencies and the scale.
    """

    languages: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and in how many each feature occurs, over all rows with a ``text``.

    Tasks count into one array; Spark adds up their counts by feature. At most ``BUCKETS`` rows reach the driver.
    """

    def count(batches):
        import pyarrow as pa

        n, place, total = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int32), 0
        for whole in batches:
            for batch in slices(whole):
                for text in batch.column("text").to_pylist():
                    grams = _distinct(_grams(text), place)
                    n[grams] += 1
                    total += len(grams) > 0
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, have].astype(np.int32)), pa.array(np.r_[total, n[have]])], names=["feature", "n"])

    found = rows.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return int(n[feature < 0].sum()), out


def _sampled(rows: DataFrame, sample: int) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """Language, whether it calibrates, features and their shares of a bounded number of documents, in a fixed order."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return []
    each = max(20, sample // len(sizes))
    hashed = F.pmod(F.xxhash64("text", F.lit(12)), F.lit(1 << 40))
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, each / size)).otherwise(share)
    chosen = rows.withColumn("hash", hashed).filter(F.col("hash") < share * float(1 << 40))

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            out = [np.unique(_grams(t), return_counts=True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("hash"), pa.array([f.astype("<i4").tobytes() for f, _ in out], pa.binary()),
                 pa.array([n.astype("<i4").tobytes() for _, n in out], pa.binary())],
                names=["lang", "hash", "features", "counts"],
            )

    # the text's hash bounds the documents, not the copies of one text: equal texts count once
    slim = chosen.select("lang", "hash", "text").mapInArrow(features, "lang string, hash long, features binary, counts binary").dropDuplicates()
    table = slim.toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (table["hash"][i].as_py(), table["lang"][i].as_py()))
    out = []
    for i in order:
        f = np.frombuffer(table["features"][i].as_buffer(), dtype="<i4")
        n = np.frombuffer(table["counts"][i].as_buffer(), dtype="<i4").astype(np.float32)
        if len(f):
            h = table["hash"][i].as_py()
            out.append((table["lang"][i].as_py(), h // 7 % CALIBRATE == 0, f, n / n.sum()))
    return out


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that minimise the summed gradients with both penalties; exactly zero up to ``L1``."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _soft(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, features: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases from ``class, features, values`` in turn, one example at a time.

    Examples weigh so that every class has the same sum of weights.
    """
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
    sizes = np.bincount([y for y, _, _ in examples], minlength=classes)
    for _ in range(rounds):
        for y, f, x in examples:
            at, value = np.append(f, features), np.append(x, 1.0)[:, None]
            w = _leader(z[at], n[at])
            slope = _soft((value * w).sum(axis=0))
            slope[y] -= 1
            g = value * slope * (len(examples) / (classes * sizes[y]))
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = _leader(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the given classes are likeliest, between 1/20 and 20.

    One error more than was seen is presumed, spread over all examples and classes: ``n`` right answers don't prove
    a probability above about ``1 - 1 / n``.
    """
    if not len(y):
        return 1.0
    low, high = np.log(0.05), np.log(20.0)
    wanted = np.full(logits.shape, 1 / (len(y) + 2) / logits.shape[1])
    wanted[np.arange(len(y)), y] += 1 - 1 / (len(y) + 2)
    loss = lambda t: -(wanted * np.log(np.maximum(_soft(logits / np.exp(t)), 1e-300))).sum()
    for _ in range(40):  # golden section of a function with one valley
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the rows that have a text and a language; other columns are not read.

    Document frequencies cover all these rows. The weights come from about ``sample`` documents, each language's
    share chosen by a hash of the text, so that repeated texts count once and every run chooses the same. Without
    such rows the model knows no language.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).dropna()
    found = _sampled(rows, sample)
    names = tuple(sorted({x[0] for x in found}))
    if not names:
        return Model((), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    total, df = document_frequencies(rows)
    idf = (SCALE * np.log((1 + total) / (1 + df))).astype(np.float64)
    index = {name: k for k, name in enumerate(names)}
    known = [(index[name], f, x * idf[f], held) for name, held, f, x in found]
    # a language all of whose documents would calibrate is learned instead
    learnable = {y for y, _, _, held in known if not held}
    learned = [(y, f, x) for y, f, x, held in known if not held or y not in learnable]
    kept = [(y, f, x) for y, f, x, held in known if held and y in learnable]
    weights, bias = train(learned, len(names), BUCKETS)
    logits = np.array([(x[:, None] * weights[f]).sum(axis=0) + bias for _, f, x in kept]).reshape(-1, len(names))
    t = temperature(logits, np.array([y for y, _, _ in kept], dtype=np.int64))
    have = np.flatnonzero((weights != 0).any(axis=1))
    return Model(names, have, weights[have] * idf[have, None], bias, t)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, its probability; rows stay as they are, repeated ones too.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned; of equally
    likely languages the first by name. Columns of the two names are replaced. The model has at most ``BUCKETS``
    rows of weights, so it is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts):
        import pandas as pd

        m = sent.value
        classes = len(m.languages)
        table = np.zeros((classes, BUCKETS), dtype=np.float32)
        table[:, m.features] = m.weights.T
        names, scores = [], []
        for one in texts.tolist():
            grams = _grams(one) if one and classes else ()
            if not len(grams):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            sums = np.array([own[grams].sum(dtype=np.float64) for own in table])
            p = _soft((sums / len(grams) + m.bias) / m.temperature)
            names.append(m.languages[int(p.argmax())])
            scores.append(float(p.max()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    name = free_name(docs, "judged")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*kept, judged(text_of(text)).alias(name)).select(*kept, f"{name}.lang_pred", f"{name}.score")
