"""Exact Lloyd rounds over whole-number vectors, with a vector approximation file.

Each vector is compressed once to a few bits per dimension, the number of the cell that its component lies in. For
the centroids of a round, lookup tables give the least and the largest squared distance between a cell and each
centroid's component; summed over the dimensions they are intervals of the whole distances. A centroid whose interval
begins behind the end of another's is out; only where several are left is the full vector compared, and only with
these. Borders of the cells come from a bounded sample and decide speed alone: a vector that lies outside the
sample's range in some dimension has no cells and is compared with every centroid.

Tasks send sums and counts per centroid, so a cluster that holds most vectors is never gathered. A round reads the
stored table once; all numbers are integers, so no order of summing changes a result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import staged

#: vectors that the borders of the cells are taken from, chosen by a hash of the id
SAMPLE = 4096
#: bits of a cell's number
BITS = 6
#: quartile ranges beyond the quartiles that cells reach at most, so that stray values don't make them wide
REACH = 6
#: vectors that are compared at once
ROWS = 4096
#: components at or beyond this make squared distances that a long may not hold
MOST = 1 << 26


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, x as double."""
    out = np.floor(scale * vectors.astype(np.float64))
    if out.size and np.abs(out).max() >= MOST:
        raise ValueError(f"components of {MOST // scale} or more make distances that a long does not hold")
    return out.astype(np.int64)


def kept(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """Rows whose vector has ``size`` components, none of them null or non-finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.filter((F.size(column) == size) & F.forall(column, good))


@dataclass(frozen=True)
class Cells:
    """Per dimension the first number of every cell but the lowest, and the range of the sample."""

    borders: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray) -> Cells:
        """Equally wide cells over the sample's range: narrow where a centroid's distance changes most, at the edges."""
        q1, q3 = np.percentile(sample, [25, 75], axis=0)
        low = np.maximum(sample.min(axis=0), np.floor(q1 - REACH * (q3 - q1)).astype(np.int64))
        high = np.minimum(sample.max(axis=0), np.ceil(q3 + REACH * (q3 - q1)).astype(np.int64))
        at = np.arange(1, 1 << BITS)
        return cls(low[:, None] - (-(high - low + 1)[:, None] * at >> BITS), low, high)

    def pack(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed cells of every vector, and which vectors have any."""
        cells = np.stack([np.searchsorted(b, v, side="right") for b, v in zip(self.borders, vectors.T, strict=True)], axis=1)
        inside = ((vectors >= self.low) & (vectors <= self.high)).all(axis=1)
        bits = (cells[:, :, None] >> np.arange(BITS)) & 1
        return np.packbits(bits.reshape(len(cells), -1).astype(np.uint8), axis=1), inside

    def bounds(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance by dimension, cell and centroid."""
        first = np.concatenate([self.low[:, None], self.borders], axis=1)[:, :, None]
        last = np.concatenate([self.borders - 1, self.high[:, None]], axis=1)[:, :, None]
        c = centroids.T[:, None, :]
        return np.maximum(np.maximum(first - c, c - last), 0) ** 2, np.maximum(np.abs(c - first), np.abs(c - last)) ** 2


def unpack(packed: np.ndarray, size: int) -> np.ndarray:
    """The cells' numbers of packed rows."""
    bits = np.unpackbits(packed, axis=1, count=size * BITS).reshape(len(packed), size, BITS)
    return np.packbits(bits, axis=2, bitorder="little")[:, :, 0]


@dataclass(frozen=True)
class Nearest:
    """Finds the nearest centroid of many vectors; of equally near ones the one with the smaller number."""

    centroids: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def __call__(self, vectors: np.ndarray, cells: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of every vector, and with how many centroids the full vector was compared."""
        cluster, compared = np.zeros(len(vectors), dtype=np.int32), np.zeros(len(vectors), dtype=np.int32)
        for start in range(0, len(vectors), ROWS):
            own = slice(start, start + ROWS)
            codes = cells[own]
            low, high = (sum(t[j][codes[:, j]] for j in range(codes.shape[1])) for t in (self.least, self.most))
            left = (low <= high.min(axis=1, keepdims=True)) | ~inside[own, None]
            n = left.sum(axis=1)
            best = left.argmax(axis=1)
            open_ = np.flatnonzero(n > 1)
            row, k = np.nonzero(left[open_])
            gap = vectors[own][open_[row]] - self.centroids[k]
            far = np.full((len(open_), len(self.centroids)), np.iinfo(np.int64).max)
            far[row, k] = np.einsum("ij,ij->i", gap, gap)
            best[open_] = far.argmin(axis=1)
            cluster[own], compared[own] = best, np.where(n > 1, n, 0)
        return cluster, compared


def approximate(vectors: DataFrame, cells: Cells, scale: int, key: str, column: str) -> DataFrame:
    """The approximation file: ``vec_id, vector`` (little-endian 32-bit) and ``cells``, null outside the sample's range."""
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{column}`").alias("v"))
    size = len(cells.low)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            whole = whole_numbers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
            codes, inside = cells.pack(whole)
            packed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), packed(whole.astype("<i4")).cast(pa.binary()),
                 pa.array([c if i else None for c, i in zip(packed(codes).to_pylist(), inside.tolist(), strict=True)], pa.binary())],
                names=["vec_id", "vector", "cells"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, vector binary, cells binary")


def _unpacked(batch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype="<i4").reshape(-1, size).astype(np.int64)
    cells = batch.column("cells").to_pylist()
    inside = np.array([c is not None for c in cells], dtype=bool)
    none = bytes(-(-size * BITS // 8))
    packed = np.frombuffer(b"".join(none if c is None else c for c in cells), dtype=np.uint8).reshape(-1, len(none))
    return vectors, unpack(packed, size), inside


def _moved(file: DataFrame, nearest: Nearest) -> np.ndarray:
    """The centroids after one round; one without vectors stays where it is."""
    count, size = nearest.centroids.shape

    def run(batches):
        import pyarrow as pa

        sums, counts = np.zeros((count, size), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for batch in batches:
            vectors, codes, inside = _unpacked(batch, size)
            cluster, _ = nearest(vectors, codes, inside)
            counts += np.bincount(cluster, minlength=count)
            for k in np.unique(cluster).tolist():
                sums[k] += vectors[cluster == k].sum(axis=0)
        have = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(have.astype(np.int32)), pa.array(counts[have]), pa.array(sums[have].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    parts = file.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", i)) for i in range(size)]).alias("sums"))
    out = nearest.centroids.copy()
    for row in total.collect():  # a row per centroid
        out[row["cluster"]] = np.array(row["sums"], dtype=np.int64) // row["n"]
    return out


def cluster(
    vectors: DataFrame, seeds: Column, centroids: int, rounds: int, size: int, scale: int, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE
) -> tuple[DataFrame, np.ndarray]:
    """Assigns every kept vector to a centroid after ``rounds`` rounds; returns the rows and the centroids.

    Vectors without exactly ``size`` finite components are left out. Centroids start as the kept vectors with the
    smallest ``seeds``, in that order (nulls last, equal ones by their components), fewer if there are fewer
    vectors. Rows: ``vec_id, cluster, distance`` (squared) and ``compared``, the centroids that the full vector was
    compared with, 0 where the cells alone told. Rows repeat as they come, other columns are not carried; an empty
    table gives no row and no centroid.
    """
    rows = kept(vectors, f"`{column}`", size)
    v = F.col(f"`{column}`").alias("v")
    first = rows.select(seeds.alias("seed"), v).orderBy(F.asc_nulls_last("seed"), "v").limit(centroids).collect()
    chosen = rows.select(v, F.xxhash64(F.col(f"`{key}`"), F.lit(13)).alias("h")).orderBy("h", "v").limit(sample).collect()
    now = whole_numbers(np.array([r["v"] for r in first], dtype=np.float64).reshape(-1, size), scale)
    sampled = whole_numbers(np.array([r["v"] for r in chosen], dtype=np.float64).reshape(-1, size), scale)
    cells = Cells.of(sampled) if len(sampled) else Cells(np.zeros((size, (1 << BITS) - 1), np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64))
    file = staged(approximate(rows, cells, scale, key, column), "va-file")
    for _ in range(rounds if len(now) else 0):
        now = _moved(file, Nearest(now, *cells.bounds(now)))
    last = Nearest(now, *cells.bounds(now))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors, codes, inside = _unpacked(batch, size)
            own, compared = last(vectors, codes, inside)
            gap = vectors - now[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(own), pa.array(np.einsum("ij,ij->i", gap, gap)), pa.array(compared)],
                names=["vec_id", "cluster", "distance", "compared"],
            )

    kind = file.schema["vec_id"].dataType.simpleString()
    return file.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, compared int"), now


def summed(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` to assigned rows."""
    rows = staged(assigned, "va-assigned")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(k, sums.get(k, 0), sum(sums.values()), d) for k, d in enumerate(digests)]
    table = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster")
