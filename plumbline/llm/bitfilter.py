"""Bloom filters over 64-bit keys, built in blocks by tasks and of a bounded size for broadcasting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes that one filter may have, whatever the corpus size
MOST_BYTES = 64 << 20
#: bytes of a block, which one task builds
BLOCK_BYTES = 1 << 20
PROBES = 4

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _step(level: int) -> np.uint64:
    return np.uint64((level + 1) * int(_C) % 2**64)


class BitFilter:
    """A filter of ``blocks`` equal blocks; the key's high bits say the block, hashes of the key its bits."""

    def __init__(self, blocks: int, block_bits: int, data: np.ndarray | None = None):
        self.blocks, self.block_bits = blocks, block_bits
        self.data = np.zeros(blocks * block_bits // 8, dtype=np.uint8) if data is None else data

    @classmethod
    def sized(cls, keys: int, bits_per_key: int = 12, most_bytes: int = MOST_BYTES) -> BitFilter:
        total = min(max(64, -(-keys * bits_per_key // 8)), most_bytes)
        blocks = -(-total // BLOCK_BYTES)
        return cls(blocks, -(-total // blocks // 8) * 64)

    def block_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(33)) % np.uint64(self.blocks)).astype(np.int64)

    def _places(self, keys: np.ndarray, level: int):
        one = mix(keys + _step(level))
        two = mix(one ^ _A) | np.uint64(1)
        base = self.block_of(keys) * self.block_bits
        for k in range(PROBES):
            yield base + ((one + np.uint64(k) * two) % np.uint64(self.block_bits)).astype(np.int64)

    def add(self, keys: np.ndarray, level: int = 0) -> None:
        for at in self._places(keys, level):
            np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def holds(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """True for every key added at this level, and rarely for others."""
        left = np.arange(len(keys))
        for k in range(PROBES):
            if not len(left):
                break
            own = keys[left]
            one = mix(own + _step(level))
            at = (one + np.uint64(k) * (mix(one ^ _A) | np.uint64(1))) % np.uint64(self.block_bits)
            at = self.block_of(own) * self.block_bits + at.astype(np.int64)
            left = left[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), dtype=bool)
        out[left] = True
        return out

    def levels(self, keys: np.ndarray, most: int = 128) -> np.ndarray:
        """How many levels, from 0 without a gap, hold each key."""
        out = np.zeros(len(keys), dtype=np.int64)
        left = np.arange(len(keys))
        for level in range(most):
            left = left[self.holds(keys[left], level)]
            if not len(left):
                break
            out[left] += 1
        return out


def build(rows: DataFrame, key: str, empty: BitFilter, levels: Column | None = None) -> BitFilter:
    """The filter of all keys (``levels`` of each: 1 by default). Rows are dealt by block, every task sets the bits
    of its blocks, and only finished blocks, at most ``MOST_BYTES`` in all, reach the driver."""
    blocks, bits = empty.blocks, empty.block_bits
    block = F.shiftrightunsigned(F.col(key), 33) % blocks
    dealt = rows.select(F.col(key).cast("long").alias("key"), (levels if levels is not None else F.lit(1)).cast("int").alias("levels"), block.cast("int").alias("block"))

    def set_bits(table):
        import pyarrow as pa

        number = table.column("block")[0].as_py()
        keys, n = table.column("key").to_numpy().view(np.uint64), table.column("levels").to_numpy()
        whole = BitFilter(1, bits)
        for level in range(int(n.max())):
            whole.add(keys[n > level], level)
        return pa.table({"block": pa.array([number], pa.int32()), "bits": pa.array([whole.data.tobytes()], pa.binary())})

    out = BitFilter(blocks, bits)
    for row in dealt.groupBy("block").applyInArrow(set_bits, "block int, bits binary").collect():
        start = row["block"] * bits // 8
        out.data[start : start + bits // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out
