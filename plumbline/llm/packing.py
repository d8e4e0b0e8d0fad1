"""Packing token pieces into sequences: a configuration linear program over the length histogram.

Only the counts of pieces by length (at most ``capacity`` numbers) reach the driver. There the linear program
"use as few patterns as cover all lengths" is solved by multiplicative weights: every length has a price that
falls as it gets covered, a knapsack dynamic program finds the patterns worth most at these prices, and each is
used for a step. Steps are rounded to whole uses as they are taken, down but to at least one, so that the prices
see the rounded solution; the last half per cent of the tokens is filled best fit, more where that saves sequences.
Each pattern owns a run of sequence numbers, so a piece finds its place from its length and its rank among
the pieces of that length; ranks are counted in salted groups, so a frequent length is no single task.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import staged, text_of

CAPACITY = 2048
#: parts of the tokens between two pricings, the share of a length that one step may cover, and how much less than the
#: dearest pattern another one of the round may be worth; how steeply prices fall with the covered share
ROUNDS, STEP, NEAR, FALL = 200, 0.5, 0.003, 1.0
#: how many beginnings of the program's steps are completed best fit
PREFIXES = 8
#: pieces of one length and salt that one task ranks, about
RANK_ROWS = 20_000


# fixed value: how byte-level tokenizers of this family cut text into words
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, its special strings, and a faster encoder of the same ids where the file allows one.

    That needs plain byte-level merges whose order is the order of ids; then merging by id is the same.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return tokenizer, special, None
    vocab, byte = model["vocab"], _byte_of()
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    words = {w: k for w, k in vocab.items() if w not in special}
    if None in made or made != sorted(made) or len(words) != len(made) + 256 or min(made) < 256:
        return tokenizer, special, None
    import tiktoken

    ranks = {bytes(byte[c] for c in w): k for w, k in words.items()}
    return tokenizer, special, tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of every text, as the tokenizer gives them without added tokens."""
    tokenizer, special, fast = _tokenizer(path)
    for text in texts:
        if fast is None or any(s in text for s in special):
            yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            yield fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token ids of every text and a closing 0, cut where they are longer than ``capacity``.

    Returns ``doc_id, piece, start, length, ids`` (``ids``: little-endian unsigned 32-bit). A longer document is
    cut into pieces of ``capacity``, of which the first may be shorter. Null and empty texts are the closing 0
    alone; repeated rows give repeated pieces; other columns are not carried.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
         T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            size = begin = 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                # a few MB of text at a time, so that neither words nor ids pile up
                if size < 4_000_000 and end < len(texts):
                    continue
                row, piece, start, length, ids = [], [], [], [], []
                for k, data in enumerate(_encoded(texts[begin:end], tokenizer_path), begin):
                    data += b"\0\0\0\0"
                    total = len(data) // 4
                    low = 0
                    high = total - capacity * ((total - 1) // capacity)
                    while low < total:
                        row.append(k)
                        piece.append(0 if low == 0 else piece[-1] + 1)
                        start.append(low)
                        length.append(high - low)
                        ids.append(data[4 * low : 4 * high])
                        low, high = high, high + capacity
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
                size, begin = 0, end

    return rows.mapInArrow(cut, schema)


def _worths(price: np.ndarray) -> np.ndarray:
    """Knapsack: the largest summed price of a pattern for every room up to the capacity (``price[n]``: of length n)."""
    best = np.zeros(len(price))
    for room in range(1, len(price)):
        best[room] = max(best[room - 1], (best[:room] + price[room:0:-1]).max())
    return best


def _dearest(first: int, best: np.ndarray, price: np.ndarray, stock: np.ndarray) -> tuple[dict[int, int], float]:
    """The dearest pattern that holds ``first`` and no more of any length than there is; equal ones by longer lengths."""
    pattern, worth, room = {first: 1}, price[first], len(price) - 1 - first
    own = price.copy()
    own[stock < 1] = -np.inf
    own[first] = price[first] if stock[first] > 1 else -np.inf
    while room:
        gain = best[:room] + own[room:0:-1]
        rest = int(gain.argmax())
        if gain[rest] == -np.inf:
            break
        n = room - rest
        pattern[n] = pattern.get(n, 0) + 1
        worth += own[n]
        if pattern[n] == stock[n]:
            own[n] = -np.inf
        room = rest
    return pattern, worth


def program(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """The linear program by multiplicative weights, in whole steps: patterns with how often each is used.

    A round prices every length at the share of a sequence that it takes times ``exp(-FALL * covered share)``, solves one
    knapsack, and takes steps of the dearest pattern of each length while these are worth nearly as much as the dearest
    of all, until a part ``1 / rounds`` of all tokens is covered. The last part is left over.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        stock[n] = c
    total, plan = stock.copy(), []
    part = max(1, int((size * total).sum()) // rounds)
    near = NEAR
    while (left := int((size * stock).sum())) > part:
        open_ = np.flatnonzero(stock)
        price = np.full(capacity + 1, -np.inf)
        price[open_] = open_ / capacity * np.exp(-FALL * (1 - stock[open_] / total[open_]))
        best = _worths(price)
        done = 0
        own = price[open_] + best[capacity - open_]
        for n in open_[np.lexsort((-open_, -own))].tolist():
            if done >= part:
                break
            if not stock[n]:
                continue
            pattern, worth = _dearest(n, best, price, stock)
            if done and worth < (1 - near) * best[capacity]:
                continue
            times = max(1, int(STEP * min(stock[m] / a for m, a in pattern.items())))
            plan.append((pattern, times))
            for m, a in pattern.items():
                stock[m] -= times * a
                done += m * times * a
        # a round that met few patterns of that worth is content with less the next time
        near = NEAR if done >= part else 2 * near
    return plan


def solve(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to number) with how often each is used; together they hold exactly the given counts.

    The program's steps are taken up to none, one, two eighths of its tokens and so on to all, and the rest is filled
    best fit; the plan with fewest sequences is returned, of equal ones the one with most steps of the program. So
    there are never more sequences than best fit alone needs.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    steps = program(counts, capacity, rounds)
    tokens = np.cumsum([times * sum(n * a for n, a in pattern.items()) for pattern, times in steps])
    plans = []
    for eighth in range(PREFIXES, -1, -1):
        taken = steps[: int(np.searchsorted(tokens, eighth / PREFIXES * tokens[-1])) + (eighth > 0)] if steps else []
        left = Counter(counts)
        for pattern, times in taken:
            left.subtract({n: a * times for n, a in pattern.items()})
        plans.append(taken + _best_fit(left, capacity))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each time the longest that still fits; a pattern repeats while its lengths last."""
    plan = []
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in left.items():
        stock[n] = c
    while stock.any():
        pattern, room = {}, capacity
        free = stock.copy()
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            n = int(fits[-1])
            take = min(int(free[n]), room // n)
            pattern[n] = pattern.get(n, 0) + take
            free[n] -= take
            room -= n * take
        times = min(int(stock[n]) // a for n, a in pattern.items())
        plan.append((pattern, times))
        for n, a in pattern.items():
            stock[n] -= times * a
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For every length, runs of ranks with the sequences and offsets they get, sorted by (length, first rank)."""
    runs, used, first = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n, a in sorted(pattern.items(), reverse=True):
            rank = used.get(n, 0)
            runs.append((n << 44 | rank, rank, times, first, offset))
            used[n] = rank + times * a
            offset += n * a
        first += times
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(runs), strict=True)) if runs else (np.zeros(0, np.int64),) * 5


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, start, length`` (each 1 to capacity long).

    Sequences are numbered from 0 and filled without gaps. Equal rows are interchangeable; an empty table stays
    empty. The table is read several times, so hand in one that is stored.
    """
    by_length = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {int(r["length"]): int(r["count"]) for r in by_length}
    keys, ranks, times, firsts, offsets = _slots(solve(counts, capacity))
    most = max(counts.values(), default=0)
    salts = max(1, -(-most // RANK_ROWS))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    group = salted.groupBy("length", "__salt").count()
    from pyspark.sql import Window

    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = group.select("length", "__salt", before.alias("__before"))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("__rank", F.row_number().over(order) - 1).join(group, ["length", "__salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted(keys, n << 44 | r, side="right") - 1
        inside = r - ranks[k]
        return pd.DataFrame({"sequence_id": firsts[k] + inside % times[k], "offset": offsets[k] + n * (inside // times[k])})

    placed = ranked.withColumn("__slot", slot(F.col("length"), (F.col("__rank") + F.col("__before")).cast("long")))
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], "__slot.sequence_id", "__slot.offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its place and the CRC-32 of its ids, texts read once."""
    pieces = token_pieces(docs, tokenizer_path, capacity, doc_id, text)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(staged(slim, "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, each at most ``capacity`` ids (one id per document)."""
    pieces = token_pieces(docs, tokenizer_path, capacity).select("doc_id", "piece", "ids")
    parts = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    joined = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return parts.groupBy("sequence_id").agg(joined.alias("p")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: x["ids"]), "")).alias("ids")
    )
