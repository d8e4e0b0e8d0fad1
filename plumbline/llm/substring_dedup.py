"""Exact repeats of long word sequences across documents, found level by level.

A window of 50 words repeats only if the 13-word runs inside it repeat, and so on upwards. At each level (13, 25
and 50 words) every window is represented by the smallest hash among its runs of that length, so windows with the
same words have the same representative, and overlapping windows share it: about one run in twenty is looked at.
Representatives that start in one document only are out; only windows whose representatives all repeat are
extended to twice the length. What repeats at a level is kept in a Bloom filter of bounded size: a false hit only
costs work at the next level, and the last level compares whole windows exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitfilter import BitFilter, build, mix
from plumbline.llm.common import staged, text_of

#: no level starts below this many words, where too much repeats by chance
SHORTEST = 12

_BASE = 0x9E3779B97F4A7C15


def levels_for(window: int) -> list[int]:
    """Lengths from about ``SHORTEST`` on, each doubling (or, to end at the window, nearly doubling) the one before."""
    out = [window]
    while (half := -(-out[0] // 2)) >= SHORTEST:
        out.insert(0, half)
    return out


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    from xxhash import xxh64_intdigest

    parts, sizes = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII blanks only
        parts.append(np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
        sizes[k] = len(words)
    return np.concatenate(parts), sizes


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on, by doubling."""
    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    power, width, out, done = h, 1, None, 0
    while length:
        if length & 1:
            part = power[done:]
            out = part if out is None else out[: len(part)] * np.uint64(pow(_BASE, width, 2**64)) + part[: len(out)]
            done += width
        length >>= 1
        if length:
            power = power[:-width] * np.uint64(pow(_BASE, width, 2**64)) + power[width:]
            width *= 2
    return mix(out[:n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _candidates(texts: list[str], window: int, lengths: list[int], filters: list[BitFilter]) -> tuple[np.ndarray, ...]:
    """Document, place and representative at level ``len(filters)`` of all windows alive at the levels before."""
    h, sizes = _hashed(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = len(h) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    alive = np.flatnonzero(doc[:n] == doc[window - 1 :])
    for level, length in enumerate(lengths[: len(filters) + 1]):
        value = _least(_runs(h, length), window - length + 1)[alive]
        if level < len(filters):
            # neighbours share their representative: look each up once
            change = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
            hit = np.repeat(filters[level].holds(value[change]), np.diff(np.r_[change, len(value)]))
            alive = alive[hit]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    return doc[alive], alive - first[doc[alive]], value


def _chunks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= most or end == len(texts):
            yield start, end
            start, size = end, 0


def _represented(rows: DataFrame, window: int, lengths: list[int], filters: list[BitFilter]) -> DataFrame:
    """``doc_id, version, key`` and, at the last level, ``place`` of the windows still alive."""
    last = len(filters) == len(lengths) - 1
    sent = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                doc, place, key = _candidates(texts[a:b], window, lengths, sent.value)
                if not last and len(key):
                    # one row per document and representative
                    order = np.lexsort((key, doc))
                    doc, place, key = doc[order], place[order], key[order]
                    new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
                    doc, place, key = doc[new], place[new], key[new]
                pick = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pick), batch.column("version").take(pick), pa.array(place.astype(np.int32)), pa.array(key.view(np.int64))],
                    names=["doc_id", "version", "place", "key"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, version long, place int, key long")


def repeated_windows(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, version, place`` of every window whose words also start a window in a document with a smaller id.

    ``version`` is the 64-bit hash of the text, so that an id given to several texts keeps them apart; windows of
    one id are never repeats of each other. Rows with a null id are neither repeats nor originals.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text")).filter("doc_id is not null")
    rows = rows.withColumn("version", F.xxhash64("text"))
    lengths, filters = levels_for(window), []
    for _ in lengths[:-1]:
        seen = _represented(rows, window, lengths, filters).groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        repeated = staged(seen.filter("a < b").select("key"), "repeats")
        filters.append(build(repeated, "key", BitFilter.sized(repeated.count())))
    final = staged(_represented(rows, window, lengths, filters), "windows")
    first = final.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return final.join(first.select("key", "first"), "key").filter("doc_id > first").select("doc_id", "version", "place")


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_removed`` and ``kept_text``: the words left, joined by one space, without every word
    covered by a window of ``window`` words that also starts in a document with a smaller id.

    Windows are judged on the input. Null and empty texts have no words; repeated rows of one id keep each other;
    other columns stay, and columns that have one of the added names are replaced.
    """
    spans = repeated_windows(docs, window, doc_id, text).groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("place")).alias("__places"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "__places")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        n, gone, kept = [], [], []
        for one, at in zip(texts.tolist(), places.tolist(), strict=True):
            words = one.encode("utf-8", "surrogatepass").split()
            n.append(len(words))
            if at is not None and len(at):
                step = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.asarray(at, dtype=np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"n_words": n, "n_removed": gone, "kept_text": kept})

    added = ("n_words", "n_removed", "kept_text")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    rows = docs.select(*kept).withColumn("__text", text_of(text))
    same = (rows[f"`{doc_id}`"] == spans["__id"]) & (F.xxhash64(rows["__text"]) == spans["__version"])
    joined = rows.join(spans, same, "left").withColumn("__cut", cut("__text", "__places"))
    return joined.select(*kept, *[F.col(f"__cut.{c}").alias(c) for c in added])
