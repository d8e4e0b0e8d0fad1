"""Language-model scores from a log-frequency Bloom filter.

Counts of single words and of word pairs are gathered over all training documents with Spark. A count is
quantised on a logarithmic scale to a level, and the n-gram goes into a Bloom filter once for every level up to
its own; probing level after level until one is missing gives the quantised count back. All n-grams are in, so the
filters grow with the corpus: that of the words, which grows with the vocabulary, is broadcast; that of the pairs
stays in blocks by key, next to the exact counts of the words of the block. Texts are hashed once; what a text
needs to know of its pairs and rarer words travels to their blocks in packed arrays, and sums come back.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitfilter import BitFilter, mix
from plumbline.llm.common import slices, staged, text_of

#: ratio of neighbouring count levels
RATIO = 1.5
#: bits of the filters per n-gram and level
BITS = 10
#: about how many words and pairs are so common that their counts are broadcast, and fewest blocks of the others
FREQUENT, COMMON, BLOCKS = 1 << 16, 1 << 16, 64
#: words or pairs that a task gathers before it hands them on; sorting them takes about 60 bytes each
GATHERED = 1_000_000

_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: bits of a pair that tell it within its block
_LOW = np.uint64((1 << 40) - 1)
_P, _Q = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
WORDS, PAIRS = 1, 2


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and ends in order, the number per text, and the hash before each (a start mark first)."""
    from xxhash import xxh64_intdigest

    parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        # of bytes, lower() and split() know the ASCII letters and blanks only
        words = text.encode("utf-8", "surrogatepass").lower().split()
        own = np.empty(len(words) + 1, dtype=np.uint64)
        own[:-1] = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        own[-1] = _END
        parts.append(own)
        sizes[k] = len(own)
    words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    before = np.r_[_START, words[:-1]] if len(words) else words
    before[np.cumsum(sizes)[:-1]] = _START
    return words, sizes, before


def _pairs(before: np.ndarray, words: np.ndarray, blocks: int) -> np.ndarray:
    """A number per pair: its block, then 40 bits that tell it there."""
    whole = mix(before * _P ^ mix(words + _Q))
    return (whole >> np.uint64(40)) % np.uint64(blocks) << np.uint64(40) | whole & _LOW


def _block(kind: int, keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each word, which is also its block in a filter of so many blocks, or of each pair."""
    return (keys >> np.uint64(33)) % np.uint64(blocks) if kind == WORDS else keys >> np.uint64(40)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log(counts) / np.log(RATIO) + 1e-9).astype(np.int64) + 1


def _put_keys(kind: int, keys: np.ndarray) -> bytes:
    """Words as eight bytes each, pairs as the five that their block doesn't tell."""
    return keys.tobytes() if kind == WORDS else keys.astype("<u8").view("u1").reshape(-1, 8)[:, :5].tobytes()


def _get_keys(kind: int, data: bytes) -> np.ndarray:
    if kind == WORDS:
        return np.frombuffer(data, dtype="<u8")
    return np.ascontiguousarray(np.pad(np.frombuffer(data, dtype="u1").reshape(-1, 5), ((0, 0), (0, 3)))).view("<u8").ravel()


def _put_counts(counts: np.ndarray) -> bytes:
    """A byte per count; those from 255 on follow in full."""
    return np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _get_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data[:n], dtype="u1").astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], dtype="<u8")
    return counts


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in held])
    counts = np.concatenate([c for _, c in held]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _spans(block: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal numbers in a sorted array."""
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=False))


def _counts(train: DataFrame, blocks: int, common: dict[int, int]) -> DataFrame:
    """A row per kind and block: ``keys`` and ``counts`` of its words, or the ``bits`` of the filter of its pairs.

    Beside them ``distinct`` n-grams, their ``total`` count, the ``inserts`` a filter of them takes, and as ``top``
    those with at least the ``common`` count of their kind.
    """

    def gather(batches):
        import pyarrow as pa

        def packed(kind: int, held: list):
            keys, counts = _summed(held)
            held.clear()
            block = _block(kind, keys, blocks)
            order = np.argsort(block, kind="stable")
            keys, counts, block = keys[order], counts[order], block[order]
            spans = _spans(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(spans), pa.int32()), pa.array([int(block[a]) for a, _ in spans], pa.int32()),
                 pa.array([_put_keys(kind, keys[a:b]) for a, b in spans], pa.binary()), pa.array([_put_counts(counts[a:b]) for a, b in spans], pa.binary())],
                names=["kind", "block", "keys", "counts"],
            )

        held: dict[int, list] = {WORDS: [], PAIRS: []}
        for whole in batches:
            for batch in slices(whole):
                words, _, before = _hashed(batch.column("text").to_pylist())
                for kind, keys in ((WORDS, words), (PAIRS, _pairs(before, words, blocks))):
                    unique, n = np.unique(keys, return_counts=True)
                    held[kind].append((unique, n.astype(np.uint32)))
                    if sum(len(k) for k, _ in held[kind]) > GATHERED:
                        yield from packed(kind, held[kind])
        for kind in held:
            yield from packed(kind, held[kind])

    def merge(table):
        import pyarrow as pa

        kind, block, held = table.column("kind")[0].as_py(), table.column("block")[0].as_py(), []
        for k, c in zip(table.column("keys"), table.column("counts"), strict=True):
            keys = _get_keys(kind, k.as_py())
            held.append((keys, _get_counts(c.as_py(), len(keys))))
        keys, counts = _summed(held)
        level, top = _levels(counts), counts >= common[kind]
        bits = None
        if kind == PAIRS:
            whole = BitFilter(1, -(-max(64, int(level.sum()) * BITS) // 64) * 64)
            for q in range(int(level.max())):
                whole.add(keys[level > q], q)
            bits = whole.data.tobytes()
        best = (keys[top] | np.uint64(block << 40 if kind == PAIRS else 0)).astype(np.uint64).view(np.int64)
        return pa.table(
            {"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int32()), "bits": pa.array([bits], pa.binary()),
             "keys": pa.array([keys.tobytes() if kind == WORDS else None], pa.binary()), "counts": pa.array([_put_counts(counts) if kind == WORDS else None], pa.binary()),
             "distinct": [len(keys)], "total": [int(counts.sum())], "inserts": [int(level.sum())],
             "top": pa.array([best.tolist()], pa.list_(pa.int64())), "top_counts": pa.array([counts[top].tolist()], pa.list_(pa.int64()))}
        )

    gathered = train.select("text").mapInArrow(gather, "kind int, block int, keys binary, counts binary")
    columns = "kind int, block int, bits binary, keys binary, counts binary, distinct long, total long, inserts long, top array<long>, top_counts array<long>"
    return gathered.groupBy("kind", "block").applyInArrow(merge, columns)


@dataclass(frozen=True)
class Model:
    """The training totals, the words' filter, the commonest words and pairs, and the table ``blocks`` of the rest."""

    words: BitFilter | None
    tokens: int
    distinct: int
    docs: int
    weight: float
    n_blocks: int = 1
    frequent: tuple[np.ndarray, np.ndarray] | None = None
    common: tuple[np.ndarray, np.ndarray] | None = None
    blocks: DataFrame | None = None

    def counted(self, level: np.ndarray) -> np.ndarray:
        """Quantised counts of levels, 0 for level 0."""
        low = RATIO ** (level - 1.0)
        return np.where(level > 0, low * (1 + RATIO) / 2 + (low <= 1) * (1 - RATIO) / 2, 0.0)

    def logs(self, pair: np.ndarray, single: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Smoothed log10 probabilities from counts; a context that never occurred counts as one that did once."""
        paired = np.minimum(pair / np.maximum(context, 1), 1)
        return np.log10((1 - self.weight) * (single + 1) / (self.tokens + self.distinct + 1) + self.weight * paired)


def _word_filter(words: DataFrame, blocks: int, inserts: int) -> BitFilter:
    """The filter of all words: tasks set the bits of their blocks, which have as many bits as the fullest needs."""
    block_bits = -(-max(64, inserts * BITS) // 64) * 64

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, k, c in zip(*(batch.column(n) for n in ("block", "keys", "counts")), strict=True):
                keys = _get_keys(WORDS, k.as_py())
                level, whole = _levels(_get_counts(c.as_py(), len(keys))), BitFilter(1, block_bits)
                for q in range(int(level.max())):
                    whole.add(keys[level > q], q)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([whole.data.tobytes()], pa.binary())], names=["block", "bits"])

    out = BitFilter(blocks, block_bits)
    for row in words.select("block", "keys", "counts").mapInArrow(run, "block int, bits binary").toLocalIterator():
        start = row["block"] * block_bits // 8
        out.data[start : start + block_bits // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def train(docs: DataFrame, text: str = "text") -> Model:
    """A model of all rows of ``docs``; null texts are empty. Without rows every token gets the add-one floor."""
    rows = docs.select(text_of(text).alias("text"))
    n_docs, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    # a block has the n-grams of about 16 MB of text, before equal ones are joined
    blocks = max(BLOCKS, size >> 24)
    # n-grams with these counts are at most a few times as many as wanted, as there are fewer tokens than bytes
    common = {WORDS: max(2, size // (8 * max(FREQUENT, 1))) if FREQUENT else 1 << 62, PAIRS: max(2, size // (8 * COMMON))}
    table = staged(_counts(rows, blocks, common), "ngram-counts")
    facts = table.groupBy("kind").agg(F.sum("distinct").alias("k"), F.sum("total").alias("n"), F.max("inserts").alias("most")).collect()
    facts = {r["kind"]: r for r in facts}
    tokens, distinct, most = (facts[WORDS]["n"], facts[WORDS]["k"], facts[WORDS]["most"]) if facts else (0, 0, 0)
    # a pair that occurs is found among the other texts about as often as its count leaves one more
    found = facts[PAIRS]["n"] - facts[PAIRS]["k"] if facts else 0
    weight = min(max(found / max(tokens, 1), 0.01), 0.95)

    def tops(kind: int) -> tuple[np.ndarray, np.ndarray]:
        lists = table.filter((F.col("kind") == kind) & (F.size("top") > 0)).select("top", "top_counts").collect()
        keys = np.array([k for r in lists for k in r["top"]], dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], np.array([c for r in lists for c in r["top_counts"]], dtype=np.int64)[order]

    words = _word_filter(table.filter(F.col("kind") == WORDS), blocks, most)
    return Model(words, tokens, distinct, n_docs, weight, blocks, tops(WORDS), tops(PAIRS), table.select("kind", "block", "bits", "keys", "counts"))


_START_LEVEL = 255


def _contexts(m: Model, level: np.ndarray) -> np.ndarray:
    return np.where(level == _START_LEVEL, float(m.docs), m.counted(np.where(level == _START_LEVEL, 0, level)))


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a sorted table has, and their counts."""
    known, counts = table
    if not len(known):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    here = known[at] == keys
    return here, np.where(here, counts[at], 0)


def _squeezed(numbers: np.ndarray, kind: str) -> bytes:
    return zlib.compress(numbers.astype(kind).tobytes(), 1)


def _opened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind).astype(np.int64)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the sum of the smoothed log10 probabilities; ``base_score`` and ``n_known`` use exact word counts.
    Those of about ``FREQUENT`` commonest words and ``COMMON`` commonest pairs are broadcast; all others are asked
    for in their block, and as none of these is common, no block gets much more than its share. Null texts are empty
    and have their end token only; rows that repeat in id and text are returned as often as they came.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(replace(model, blocks=None))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    own = {"n_tokens": "long", "n_known": "long", "base": "double", "score": "double"}

    def ask(batches):
        """Rows ``kind, block, docs, versions`` with, for kind 0, the documents' own sums, else what is asked for."""
        import pyarrow as pa

        m = sent.value
        for whole in batches:
            for batch in slices(whole):
                words, sizes, before = _hashed(batch.column("text").to_pylist())
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                unique, where = np.unique(words, return_inverse=True)
                single = m.words.levels(unique)[where]
                context = np.r_[0, single[:-1]]
                context[starts] = _START_LEVEL
                pairs = _pairs(before, words, m.n_blocks)
                paired, pair = _found(m.common, pairs)
                logs = np.zeros(len(words))
                at = np.flatnonzero(paired)
                logs[at] = m.logs(m.counted(_levels(pair[at])), m.counted(single[at]), _contexts(m, context[at]))
                top, n = (x[where] for x in _found(m.frequent, unique))
                sums = [sizes, np.add.reduceat(top.astype(np.int64), starts), np.add.reduceat(np.log10(n + 1), starts), np.add.reduceat(logs, starts)]
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                main = int(batch.column("version")[0].as_py()) % m.n_blocks
                parts = [(0, main, np.arange(batch.num_rows), [*(pa.array([x.tolist()], pa.list_(t)) for x, t in zip(sums, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)), *[None] * 4])]
                for what, keys, left in ((WORDS, words, np.flatnonzero(~top)), (PAIRS, pairs, np.flatnonzero(~paired))):
                    block = _block(what, keys[left], m.n_blocks)
                    order = np.argsort(block, kind="stable")
                    left, block = left[order], block[order]
                    for a, b in _spans(block):
                        mine = left[a:b]
                        docs, times = np.unique(doc[mine], return_counts=True)  # positions come in the documents' order
                        levels = [_squeezed(x[mine], "u1") for x in (single, context)] if what == PAIRS else [None, None]
                        parts.append((what, int(block[a]), docs, [None] * 4 + [_squeezed(times, "<u4"), _put_keys(what, keys[mine]), *levels]))
                ends = pa.array(np.r_[0, np.cumsum([len(p[2]) for p in parts])].astype(np.int32))
                docs = pa.array(np.concatenate([p[2] for p in parts]))
                lists = [pa.concat_arrays([pa.nulls(1, pa.list_(t)) if p[3][i] is None else p[3][i] for p in parts]) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()),
                     pa.ListArray.from_arrays(ends, batch.column("doc_id").take(docs)), pa.ListArray.from_arrays(ends, batch.column("version").take(docs)),
                     *lists, *(pa.array([p[3][i] for p in parts], pa.binary()) for i in range(4, 8))],
                    names=["kind", "block", "docs", "versions", *own, "times", "keys", "single", "context"],
                )

    def answer(asked, held):
        import pyarrow as pa

        m, known, pairs = sent.value, None, None
        for k in range(held.num_rows):
            if held.column("kind")[k].as_py() == WORDS:
                keys = _get_keys(WORDS, held.column("keys")[k].as_py())
                known = keys, _get_counts(held.column("counts")[k].as_py(), len(keys))
            else:
                data = np.frombuffer(held.column("bits")[k].as_py(), dtype=np.uint8)
                pairs = BitFilter(1, len(data) * 8, data)
        known = known or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out: dict[str, list] = {c: [] for c in ("doc_id", "version", "main", *own)}
        for batch in asked.to_batches():
            cell = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                what, n = cell["kind"][k].as_py(), len(cell["docs"][k].values)
                out["doc_id"].append(cell["docs"][k].values)
                out["version"].append(cell["versions"][k].values)
                out["main"].append(pa.array(np.full(n, what == 0)))
                if what == 0:
                    for c in own:
                        out[c].append(cell[c][k].values)
                    continue
                keys, times = _get_keys(what, cell["keys"][k].as_py()), _opened(cell["times"][k].as_py(), "<u4")
                at, none = np.r_[0, np.cumsum(times)[:-1]], np.zeros(n)
                if what == WORDS:
                    here, c = _found(known, keys)
                    sums = np.add.reduceat(here.astype(np.int64), at), np.add.reduceat(np.log10(c + 1), at), none
                else:
                    single, context = (_opened(cell[c][k].as_py(), "u1") for c in ("single", "context"))
                    level = pairs.levels(keys) if pairs else np.zeros(len(keys), dtype=np.int64)
                    sums = none.astype(np.int64), none, np.add.reduceat(m.logs(m.counted(level), m.counted(single), _contexts(m, context)), at)
                for c, x in zip(own, (none.astype(np.int64), *sums), strict=True):
                    out[c].append(pa.array(x))
        kinds = {"doc_id": asked.schema.field("docs").type.value_type, "version": pa.int64(), "main": pa.bool_()}
        kinds |= {c: pa.int64() if t == "long" else pa.float64() for c, t in own.items()}
        return pa.table({c: pa.concat_arrays(x) if x else pa.array([], kinds[c]) for c, x in out.items()})

    lists = ", ".join(f"{c} array<{t}>" for c, t in own.items())
    asks = rows.select("doc_id", "text", "version").mapInArrow(
        ask, f"kind int, block int, docs array<{kind}>, versions array<long>, {lists}, times binary, keys binary, single binary, context binary"
    )
    sums = ", ".join(f"{c} {t}" for c, t in own.items())
    answers = asks.groupBy("block").cogroup(model.blocks.groupBy("block")).applyInArrow(answer, f"doc_id {kind}, version long, main boolean, {sums}")
    floor = float(np.log10(model.tokens + model.distinct + 1))
    times = F.sum(F.col("main").cast("long"))
    whole = answers.groupBy("doc_id", "version").agg(
        times.alias("times"),
        *[(F.sum(c) / times).cast("long").alias(c) for c in ("n_tokens", "n_known")],
        *[(F.sum(c) / times).alias(c) for c in ("base", "score")],
    )
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return whole.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score",
    )


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text leaves 2 when divided by 7; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
