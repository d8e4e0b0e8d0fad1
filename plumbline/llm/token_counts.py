"""Token counts of a byte-fallback piece model by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of spaces and the word after it; no piece of such a model crosses the
next space). The pre-tokens of a batch that were not met before are held as one ragged numpy array; in every
round each sequence merges its leftmost lowest-rank pair, all sequences at once, and sequences without a
mergeable pair leave with their count of symbols.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of

#: remembered pre-tokens per Python worker; the memory is emptied when full
REMEMBERED = 600_000
#: sequences of more symbols are merged one by one with a heap, whose time grows as n log n
LONG_SEQUENCE = 1_500
#: symbols merged together at once
ROUND_SYMBOLS = 2_000_000

_SPACE = "▁"
_RUNS = re.compile(" +[^ ]*")


class PieceMerger:
    """Merge tables of one model; ``count`` gives the number of tokens of each pre-token."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        scores = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                scores[model.id_to_piece(i)] = model.get_score(i)
        if any(_SPACE in p.lstrip(_SPACE) for p in scores):
            raise ValueError("a piece reaches over a space, so words cannot be counted apart")
        ids = {p: k for k, p in enumerate(scores)}
        for p in scores:
            for ch in p:
                ids.setdefault(ch, len(ids))
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, s in scores.items():
            for cut in range(1, len(p)):
                left, right = ids.get(p[:cut]), ids.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = (order[s], ids[p])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        # by code point: the symbol, and the tokens it makes if it stays alone (its UTF-8 bytes where it is no piece)
        points = np.arange(0x110000)
        self.weight_of = (1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)).astype(np.int8)
        self.symbol_of = np.full(0x110000, len(ids), dtype=np.int64)
        for p, k in ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = k
                if p in scores:
                    self.weight_of[ord(p)] = 1

    def count(self, tokens: list[str]) -> list[int]:
        """The number of tokens of each pre-token (given with its spaces as the model's space mark)."""
        out, start, total = [], 0, 0
        for k, token in enumerate(tokens):
            total += len(token)
            if total >= ROUND_SYMBOLS:
                out += self._together(tokens[start : k + 1])
                start, total = k + 1, 0
        return out + self._together(tokens[start:])

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge table, -1 without one."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _together(self, tokens: list[str]) -> list[int]:
        if not tokens:
            return []
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        sym, weight = self.symbol_of[points], self.weight_of[points].astype(np.int64)
        seq = np.repeat(np.arange(len(lens)), lens)
        counts = np.zeros(len(lens), dtype=np.int64)
        for long in np.flatnonzero(lens > LONG_SEQUENCE).tolist():
            own = seq == long
            counts[long] = self._one_by_one(sym[own].tolist(), weight[own].tolist())
            sym, weight, seq = sym[~own], weight[~own], seq[~own]
        none, far = np.int64(2**62), np.int64(32)
        # pair[i] joins i and i + 1; the last symbol of a sequence joins nothing
        pair = np.full(len(sym), -1, dtype=np.int64)
        pair[:-1] = np.where(seq[:-1] == seq[1:], self._lookup(sym[:-1], sym[1:]), -1)
        while len(sym):
            # rank first, then place: the minimum of a sequence is its leftmost lowest-rank pair
            rank = np.where(pair >= 0, self.ranks[pair] << far | np.arange(len(sym)), none)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            alive = best < none
            place = best[alive] & 0xFFFFFFFF
            sym[place] = self.merged[pair[place]]
            weight[place] = 1
            keep = np.ones(len(sym), dtype=bool)
            keep[place + 1] = False
            if not alive.all():
                ended = ~np.repeat(alive, np.diff(np.r_[starts, len(seq)]))
                counts += np.bincount(seq[ended], weight[ended], minlength=len(counts)).astype(np.int64)
                keep &= ~ended
            moved = (np.cumsum(keep) - 1)[place]
            sym, weight, seq, pair = sym[keep], weight[keep], seq[keep], pair[keep]
            # only pairs that touch a merged symbol are new
            for at in (moved, moved[moved > 0] - 1):
                right = np.minimum(at + 1, len(sym) - 1)
                joined = (right > at) & (seq[at] == seq[right])
                pair[at] = np.where(joined, self._lookup(sym[at], sym[right]), -1)
        return counts.tolist()

    def _one_by_one(self, sym: list[int], weight: list[int]) -> int:
        n, pairs = len(sym), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if after[i] < n and (found := pairs.get(sym[i] << 24 | sym[after[i]])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[after[i]], found[1]))

        for i in range(n - 1):
            offer(i)
        live = [True] * n
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            if not live[i] or sym[i] != a or after[i] >= n or sym[after[i]] != b:
                continue
            gone = after[i]
            live[gone] = False
            sym[i], weight[i], after[i] = merged, 1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return sum(w for w, on in zip(weight, live, strict=True) if on)


@lru_cache(maxsize=2)
def _merger(model_path: str) -> tuple[PieceMerger, dict[str, int]]:
    return PieceMerger(model_path), {}


def _counts(texts: list[str], merger: PieceMerger, met: dict[str, int]) -> list[int]:
    if len(met) > REMEMBERED:
        met.clear()
    cut = []
    missing: set[str] = set()
    for text in texts:
        if not text:
            cut.append([])
            continue
        text = " " + text.replace(_SPACE, " ")
        if "  " in text:
            words = [run[1:] for run in _RUNS.findall(text)]
        else:
            words = text[1:].split(" ")
        missing |= set(words).difference(met)
        cut.append(words)
    if missing:
        new = list(missing)
        met.update(zip(new, merger.count([(" " + w).replace(" ", _SPACE) for w in new]), strict=True))
    look = met.__getitem__
    return [sum(map(look, words)) for words in cut]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds ``out``: the number of tokens of the whole text, without begin, end or special tokens.

    Null and empty texts have 0 tokens. Repeated rows are counted one by one; all other columns stay, and a
    column already named ``out`` is replaced. No row moves: there is no shuffle. The model file must be at the
    same path on every worker, as an installed package puts it.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger, met = _merger(model_path)
        for batch in batches:
            texts, counts, size, start = batch.tolist(), [], 0, 0
            # a few MB of text at a time, so that the cut words stay small
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 4_000_000:
                    counts += _counts(texts[start : i + 1], merger, met)
                    size, start = 0, i + 1
            yield pd.Series(counts + _counts(texts[start:], merger, met), dtype="int64")

    return docs.withColumn(out, tokens(text_of(text)))
