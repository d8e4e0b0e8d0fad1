"""Filter interaction audit with wide packed counters.

Every document has a mask of the filters it fails. For a mask, what happens at each step of each order of the
filters is known beforehand, so each mask stands for one big integer whose 64-bit fields hold all step outcomes
(600 steps for five filters, six outcomes each). A task adds the integers of its rows part by part; the sums meet
in two levels, and the fields of a part's last sum are its counts. A field holds the count of at most 2**63 rows,
so none can reach into the next.

Whether a text is a copy of a smaller id's is settled per distinct text: all its rows are first counted as copies,
and those of the smallest id are then moved back by the difference of two integers. So a large group of copies is
never joined or gathered, only reduced to its smallest id.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, staged, text_of

#: the filters of texts, in the order of the mask's bits; the last one is about copies
FILTERS = "ABCDE"
#: what is counted for every step, in the order of the fields
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: tasks whose sums meet first, by the remainder of their number
SLOTS = 1024
#: sums of parts that a task holds before it hands them on, each of about 29 kB
HELD_PARTS = 500

_UPPER, _MARKS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
#: bytes that continue a character; all others begin one
_LATER = bytes(range(0x80, 0xC0))


def fails_of(data: bytes) -> int:
    """Bits A to D of one UTF-8 text: short, repetitive, shouting, marked."""
    words = data.split()  # of bytes, split() knows the six ASCII blanks only
    short = len(words) < 200
    repetitive = 100 * len(set(words)) < 50 * len(words)
    shouting = 100 * (len(data) - len(data.translate(None, _UPPER))) > 3 * len(data.translate(None, _LATER))
    marked = len(data.translate(None, _MARKS)) < len(data)
    return short | repetitive << 1 | shouting << 2 | marked << 3


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id, part, mask, digest`` of every row: bits A to D and the 128-bit digest of the whole text.

    Null texts count as empty, a null part is the empty string; rows repeat as they come.
    """
    from hashlib import blake2b

    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_of(text).alias("text")
    )

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), pa.array(map(fails_of, texts), pa.int32()),
                     pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())],
                    names=["doc_id", "part", "mask", "digest"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


@lru_cache(maxsize=4)
def _orders(n: int) -> np.ndarray:
    return np.array(list(permutations(range(n))), dtype=np.int64).reshape(-1, n)


@lru_cache(maxsize=1024)
def packed(mask: int, good: bool, toxic: bool, n: int) -> int:
    """The integer of one mask: per outcome, order and step one 64-bit field with 1 or 0."""
    orders = _orders(n)
    fails = (mask >> orders) & 1 == 1
    before = np.cumsum(fails, axis=1) - fails > 0
    removed = fails & ~before
    alone = fails & (mask.bit_count() == 1)
    out = np.stack([~fails & ~before, removed, fails & before, alone, removed & good, removed & toxic])
    return int.from_bytes(out.astype("<u8").tobytes(), "little")


def _added(rows, n: int):
    """Sums of ``part, code, copies`` rows as ``part, slot, total``: code is the mask with good and toxic on top."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        slot, held = TaskContext.get().partitionId() % SLOTS, {}

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([slot] * len(held), pa.int32()), pa.array([_bytes(v) for v in held.values()], pa.binary())],
                names=["part", "slot", "total"],
            )
            held.clear()
            return batch

        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for part, code, weight in zip(*(batch.column(c).to_pylist() for c in ("part", "code", "weight")), strict=True):
                counts[part, code] = counts.get((part, code), 0) + weight
            for (part, code), weight in counts.items():
                held[part] = held.get(part, 0) + weight * packed(code & (1 << n) - 1, bool(code >> n & 1), bool(code >> n + 1 & 1), n)
            if len(held) > HELD_PARTS:
                yield out()
        yield out()

    return rows.mapInArrow(run, "part string, slot int, total binary")


def _bytes(value: int) -> bytes:
    return value.to_bytes(value.bit_length() // 8 + 1, "little", signed=True)


def _sum(table) -> int:
    return sum(int.from_bytes(x.as_py(), "little", signed=True) for x in table.column("total"))


def tally(coded: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit of rows ``part, code, weight``: one row per part, order of the filters and step.

    ``code`` has the mask in its low bits, bit 0 for the first filter, then a bit for good and one for toxic;
    ``weight`` says how often the row counts and may be negative, as long as no sum of a part is. Returns ``part,
    filter_order, step`` and the outcomes, with ``shapley``: how many rows the step's filter removes over all orders.
    An empty table has no part and gives no row.
    """
    n, fields = len(names), 0
    fields = len(OUTCOMES) * math.factorial(n) * n

    def meet(table):
        import pyarrow as pa

        return pa.table({"part": table.column("part").slice(0, 1), "total": pa.array([_bytes(_sum(table))], pa.binary())})

    def unpack(table):
        import pyarrow as pa

        orders = _orders(n)
        data = _sum(table).to_bytes(8 * fields, "little")
        counts = np.frombuffer(data, dtype="<u8").astype(np.int64).reshape(len(OUTCOMES), -1)
        order = np.repeat(["".join(names[k] for k in o) for o in orders.tolist()], n)
        shapley = np.bincount(orders.ravel(), counts[1], minlength=n).astype(np.int64)[orders.ravel()]
        columns = {"part": [table.column("part")[0].as_py()] * len(order), "filter_order": order, "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))}
        return pa.table(columns | dict(zip(OUTCOMES, counts, strict=True)) | {"shapley": shapley})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))
    first = _added(coded, n).groupBy("part", "slot").applyInArrow(meet, "part string, total binary")
    return first.groupBy("part").applyInArrow(unpack, schema)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of filters A to E over all documents, see ``tally`` for its columns.

    ``labels`` holds ``doc_id, quality, toxic``; a document counts as good or toxic if any row of its id says so, and
    as neither without one. A row fails E if a row with a smaller id has the same text; a null id counts as larger
    than all others, and rows that repeat an id and its text don't fail for one another. Null texts are empty. Columns
    other than the named ones are not read.
    """
    measured = measure(docs, doc_id, text, part)
    marks = labels.groupBy("doc_id").agg(_any("quality").alias("good"), _any("toxic").alias("toxic"))
    rows = measured.join(marks, "doc_id", "left")
    bits = 1 << len(FILTERS) - 1
    code = F.col("mask") + F.when(F.col("good"), bits << 1).otherwise(0) + F.when(F.col("toxic"), bits << 2).otherwise(0)
    rows = rows.select("doc_id", "digest", "part", code.cast("int").alias("code"))
    # a few dozen bytes a row, read twice
    rows = staged(rows.groupBy("doc_id", "digest", "part", "code").agg(F.count("*").alias("n")), "filter-audit")
    by_id = rows.groupBy("digest", "doc_id").agg(F.collect_list(F.struct("part", "code", "n")).alias("own"))  # a row per part
    first = by_id.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("f"))
    first = first.select(F.explode("f.own").alias("o")).select("o.part", "o.code", "o.n")
    back = F.explode(F.array(F.struct(F.col("code"), F.col("n").alias("weight")), F.struct((F.col("code") + bits).alias("code"), (-F.col("n")).alias("weight"))))
    coded = rows.select("part", (F.col("code") + bits).alias("code"), F.col("n").alias("weight"))
    return tally(coded.unionByName(first.select("part", back.alias("b")).select("part", "b.code", "b.weight")))


def _any(label: str) -> Column:
    return F.coalesce(F.max(F.col(label) == 1), F.lit(False))
