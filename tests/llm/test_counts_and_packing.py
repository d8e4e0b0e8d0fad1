import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import packing, token_counts
from tests.llm.helpers import ODD, documents, edited, empty_documents, odd_documents, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    return [*ODD, *(edited(prose(k, 80), k, 20) for k in range(30)), "antidisestablishmentarianism " * 3, "                x   y", "▁▁▁▁▁▁▁"]


def test_token_counts_equal_the_library(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark, texts).selectExpr("*", "'old' as n_tokens")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_long_sequences_merge_like_short_ones():
    merger = token_counts.PieceMerger(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    long = "".join(edited(prose(k, 40), k, 10) for k in range(20)).replace(" ", "")
    assert len(long) > token_counts.LONG_SEQUENCE
    assert merger.count(["▁" + long, "▁" + long[:700]]) == [len(model.encode(long)), len(model.encode(long[:700]))]


def test_token_counts_of_odd_and_empty_tables(spark):
    rows = token_counts.count_tokens(odd_documents(spark), PIECES).collect()
    assert len(rows) == 3 * len(ODD)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert token_counts.count_tokens(empty_documents(spark), PIECES).count() == 0


def expected_pieces(text, capacity=2048):
    ids = [*Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, 0]
    out, low = [], 0
    high = len(ids) - capacity * ((len(ids) - 1) // capacity)
    while low < len(ids):
        out.append((low, high - low, zlib.crc32(np.array(ids[low:high], dtype="<u4").tobytes())))
        low, high = high, high + capacity
    return out


def test_pieces_and_places(spark, texts):
    many = [*texts, *(prose(k, 40 + 37 * k) for k in range(40))]
    docs = documents(spark, many).selectExpr("*", "1 as sequence_id", "2 as length")
    rows = packing.pack(docs, BYTES).collect()
    want = {(i, p): x for i, t in enumerate(many) for p, x in enumerate(expected_pieces(t))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(filled.values()) // 2048) + 1


def test_sequences_hold_the_pieces(spark):
    docs = documents(spark, [prose(k, 100 + k) for k in range(25)])
    placed = packing.pack(docs, BYTES)
    whole = packing.sequences(docs, placed, BYTES).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(r["length"] for r in placed.collect())


def test_packing_of_odd_and_empty_tables(spark):
    rows = packing.pack(odd_documents(spark), BYTES).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(1 for r in rows if r["length"] == 1) == 3 * 2
    assert packing.pack(empty_documents(spark), BYTES).count() == 0


@pytest.mark.parametrize("counts", [{5: 7}, {2048: 3}, {1025: 10, 1023: 10}, {n: 3 for n in range(1, 900, 7)}, {}])
def test_plans_hold_exactly_the_counts(counts):
    plan = packing.solve(counts, rounds=60)
    held = Counter()
    for pattern, times in plan:
        assert sum(n * a for n, a in pattern.items()) <= 2048
        for n, a in pattern.items():
            held[n] += a * times
    assert held == Counter(counts)
    bound = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert sum(t for _, t in plan) <= max(bound + 1, counts.get(2048, 0))


@pytest.mark.parametrize("shape", ["lognormal", "thirds"])
def test_the_program_places_the_pieces(shape):
    rng = np.random.default_rng(1)
    drawn = np.clip(rng.lognormal(6, 0.8, 60_000), 1, 2048) if shape == "lognormal" else rng.integers(400, 1100, 30_000)
    counts = Counter(drawn.astype(int).tolist())
    program = packing.program(counts)
    placed = sum(a * times for pattern, times in program for a in pattern.values())
    assert placed >= 0.95 * len(drawn)
    needed, plain = (sum(t for _, t in plan) for plan in (packing.solve(counts), packing._best_fit(counts, 2048)))
    assert -(-int(sum(n * c for n, c in counts.items())) // 2048) <= needed <= plain
    if shape == "thirds":  # best fit starts with the longest, which leaves no room for a third piece
        assert needed < 0.97 * plain


def test_ranks_of_a_hot_length_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "cast(if(id % 3 = 0, id % 90 + 1, 600) as long) as length")
    rows = packing.place(pieces).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
