"""Products of ranks over whole tables, for columns that miss rows in a few patterns.

A column's ranks depend on the rows counted: its own, or those where a *partner* pattern holds values too. Its cells
are cut into pieces of similar size and counted, each value that is a cut in a piece of its own. Cells between cuts move
to the task of their piece, packed by block of rows, are ranked there for all partners, and the ranks go back to the
block. Cells equal to a cut have their ranks from the counts alone, as have columns of few values, so that no frequent
value fills a task, and no row moves. Ranks are twice their distance from the mean rank, whole numbers that add up
to zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exprs import q
from plumbline.functions.ranges import cell_bounds, parts_for

# cells of a block of rows, and of the columns a task holds at once
BLOCK_CELLS = 4_000_000
# pieces to a task of a large table
TASK_PIECES = 4
# ranks of a cell that the sizes of blocks and pieces are meant for
USUAL_PARTNERS = 4
UNSTABLE = "rows came in another order when a task was run again; store the table first"

_PACKED = "slot int, part long, block string, size int, column int, piece int, cells binary, marks binary"
_SUMS = "i int, j int, n long, ab double, aa double, bb double"


@dataclass(frozen=True)
class Layout:
    """What is asked of the columns, by position.

    ``pattern`` is each column's pattern of gaps, -1 for none; ``asks`` the partners each column is ranked with, -1 for
    its own rows alone; ``runs`` the patterns that rows must have, the columns with their partners, and the pairs, each
    with the two columns and their places among these.
    """

    pattern: list[int]
    patterns: int
    asks: list[list[int]]
    runs: list[tuple[list[int], list[tuple[int, int]], list[tuple[int, int, int, int]]]]

    @property
    def width(self) -> int:
        """How much more than usual the ranks of a cell take: blocks and pieces are smaller by that."""
        return -(-max(map(len, self.asks)) // USUAL_PARTNERS)

    def here(self, cells: np.ndarray) -> list[np.ndarray]:
        """By pattern, which rows of a block hold values."""
        return [_held(cells[self.pattern.index(p)]) for p in range(self.patterns)]


def layout(pattern: Sequence[int], pairs: Sequence[tuple[int, int]]) -> Layout:
    """The runs of all pairs of columns: one for each pattern, and one for each two of them."""
    found: dict[frozenset[int], list[tuple[int, int]]] = {}
    for a, b in pairs:
        found.setdefault(frozenset({pattern[a], pattern[b]} - {-1}), []).append((a, b))
    asks: list[set[int]] = [set() for _ in pattern]
    runs = []
    for held, some in found.items():
        used = {}
        for c in sorted({c for pair in some for c in pair}):
            # one other pattern at most: a run has two, or one and columns without gaps
            partner = next(iter(held - {pattern[c]}), -1)
            asks[c].add(partner)
            used[c] = (len(used), partner)
        runs.append((sorted(held), [(c, p) for c, (_, p) in used.items()], [(a, b, used[a][0], used[b][0]) for a, b in some]))
    return Layout(list(pattern), max(pattern, default=-1) + 1, [sorted(s) for s in asks], runs)


def _offsets(counts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """From the rows of each piece or value in order: what to add to twice the rank within a piece, or, of a single
    value (``cut``), twice its rank; both less twice the mean rank."""
    before = np.cumsum(counts) - counts
    return 2 * before - counts.sum() + np.where(cut, counts, -1)


def value_counts(df: DataFrame, ids: Sequence[str], columns: Sequence[int], plan: Layout) -> dict[int, tuple[np.ndarray, dict[int, np.ndarray]]]:
    """Of columns with few values: the values in order, and by partner their ranks; from one grouped count."""
    if not columns:
        return {}
    here = [q(ids[plan.pattern.index(p)]).isNotNull().alias(f"h{p}") for p in range(plan.patterns)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), q(ids[c]).alias("value")) for c in columns])
    long = df.select(*here, F.inline(cells)).filter(F.col("value").isNotNull())
    by_partner = [F.count_if(F.col(f"h{p}")).alias(f"n{p}") for p in range(plan.patterns)]
    table = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), *by_partner).toArrow()
    column, value = table["column"].to_numpy(), table["value"].to_numpy()
    out = {}
    for c in columns:
        own = np.flatnonzero(column == c)
        own = own[np.argsort(value[own])]
        counts = {p: table["n" if p < 0 else f"n{p}"].to_numpy()[own] for p in plan.asks[c]}
        out[c] = value[own], {p: _offsets(n, np.ones(len(n), bool)) for p, n in counts.items()}
    return out


def with_codes(df: DataFrame, ids: Sequence[str], few: dict[int, tuple[np.ndarray, dict[int, np.ndarray]]]) -> DataFrame:
    """The columns, those of few values as the place of the value in its order, sent to where the rows are."""
    for c, (values, _) in few.items():
        codes = df.sparkSession.createDataFrame(pa.table({ids[c]: pa.array(values, pa.float64()), f"k_{ids[c]}": pa.array(np.arange(len(values)), pa.int32())}))
        df = df.join(F.broadcast(codes), ids[c], "left")
    return _as_cells(df, [f"k_{x}" if c in few else x for c, x in enumerate(ids)])


def _as_cells(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A row's numbers as one array, NaN where missing: it goes to Python at half the cost of as many columns."""
    return df.select(F.array(*[F.coalesce(q(x).cast("double"), F.lit(float("nan"))) for x in ids]).alias("cells"))


def _blocks(batches: Iterator[pa.RecordBatch], columns: int, width: int = 1) -> Iterator[np.ndarray]:
    """The rows of ``_as_cells``, columns first, a few hundred thousand rows at once, the more columns the fewer."""
    most, held, rows = max(1, BLOCK_CELLS // (columns * width)), [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).flatten().to_numpy().reshape(-1, columns))
            rows += batch.num_rows
        if rows >= most:
            yield np.ascontiguousarray(np.concatenate(held).T)
            held, rows = [], 0
    if held:
        yield np.ascontiguousarray(np.concatenate(held).T)


def _held(cells: np.ndarray) -> np.ndarray:
    return ~np.isnan(cells)


def gap_patterns(df: DataFrame, ids: Sequence[str]) -> tuple[int, list[int]]:
    """Row count, and of each column the number of its pattern: those that miss exactly the same rows share it, -1 where
    none is missing. Counts of rows that two columns both miss tell it."""
    pairs = np.triu_indices(len(ids))

    def count(batches):
        rows, both = 0, np.zeros((len(ids), len(ids)))
        for cells in _blocks(batches, len(ids)):
            rows += cells.shape[1]
            gaps = (~_held(cells)).astype("float32")
            both += gaps @ gaps.T
        yield pa.RecordBatch.from_pydict(
            {"i": np.r_[-1, pairs[0]].astype("int32"), "j": np.r_[-1, pairs[1]].astype("int32"), "n": np.r_[rows, both[pairs]].astype("int64")}
        )

    parts = _as_cells(df, ids).mapInArrow(count, "i int, j int, n long")
    both = {(r["i"], r["j"]): r["n"] for r in parts.groupBy("i", "j").agg(F.sum("n").alias("n")).collect()}
    pattern: list[int] = []
    for j in range(len(ids)):
        missing = both.get((j, j), 0)
        same = next((i for i in range(j) if missing and both[i, i] == both[i, j] == missing), None)
        pattern.append(pattern[same] if same is not None else max(pattern, default=-1) + 1 if missing else -1)
    return both.get((-1, -1), 0), pattern


def _pieces(cells: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """``2 i`` between cuts, ``2 i + 1`` for the ``i``-th cut itself."""
    place = np.searchsorted(cuts, cells)
    if not len(cuts):
        return place.astype("uint16")
    return (2 * place + (cuts[np.minimum(place, len(cuts) - 1)] == cells)).astype("uint16")


def piece_counts(df: DataFrame, ids: Sequence[str], cuts: dict[int, np.ndarray], plan: Layout) -> dict[int, dict[int, np.ndarray]]:
    """Of columns with many values: by partner, the ranks that each piece begins with, from one pass over the rows."""

    def count(batches):
        sums = {(c, p): np.zeros(2 * len(cuts[c]) + 1, "int64") for c in cuts for p in plan.asks[c]}
        for cells in _blocks(batches, len(plan.pattern)):
            here = plan.here(cells)
            for c in cuts:
                own = _held(cells[c])
                piece = _pieces(cells[c][own], cuts[c])
                for p in plan.asks[c]:
                    sums[c, p] += np.bincount(piece if p < 0 else piece[here[p][own]], minlength=len(sums[c, p]))
        for (c, p), n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {"column": np.full(len(some), c, "int32"), "partner": np.full(len(some), p, "int32"), "piece": some.astype("int32"), "n": n[some]}
            )

    parts = _as_cells(df, ids).mapInArrow(count, "column int, partner int, piece int, n long")
    table = parts.groupBy("column", "partner", "piece").agg(F.sum("n").alias("n")).toArrow()
    column, partner, piece, n = (table[c].to_numpy() for c in ("column", "partner", "piece", "n"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for c in cuts:
        for p in plan.asks[c]:
            own = (column == c) & (partner == p)
            counts = np.zeros(2 * len(cuts[c]) + 1, "int64")
            counts[piece[own]] = n[own]
            out.setdefault(c, {})[p] = _offsets(counts, np.arange(len(counts)) % 2 == 1)
    return out


def _sums(places: list[np.ndarray], here: list[np.ndarray], local: dict, offsets: dict, plan: Layout) -> pa.RecordBatch:
    """Sums of products of the ranks of a block of rows, for every pair of columns.

    ``places`` has the code or piece of each cell held, ``local`` the ranks within the pieces between cuts, in order of
    pieces and rows.
    """
    rows = []
    for held, used, pairs in plan.runs:
        ranks = []
        for c, p in used:
            place = places[c]
            if p >= 0:
                place = place[here[p] if plan.pattern[c] < 0 else here[p][here[plan.pattern[c]]]]
            rank = offsets[c][p][place]
            if (c, p) in local:
                order = np.argsort(place, kind="stable")
                order = order[place[order] % 2 == 0]
                if len(order) != len(local[c, p]):
                    raise RuntimeError(UNSTABLE)
                rank[order] += local[c, p]
            ranks.append(rank.astype("float64"))
        x = np.stack(ranks)
        m = x @ x.T
        rows += [(i, j, x.shape[1], m[a, b], m[a, a], m[b, b]) for i, j, a, b in pairs]
    kinds = {"i": "int32", "j": "int32", "n": "int64", "ab": "float64", "aa": "float64", "bb": "float64"}
    return pa.RecordBatch.from_pydict({name: np.array(x, kind) for (name, kind), x in zip(kinds.items(), zip(*rows))})


def _pack(df: DataFrame, cuts: dict[int, np.ndarray], plan: Layout) -> DataFrame:
    """Blocks of rows: a line per column and piece between cuts, with its cells, and lines with the place of each cell."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, cells in enumerate(_blocks(batches, len(plan.pattern), plan.width)):
            # rows that come in another order when the task is run again make another block, which then lacks cells
            place, block, size = (task << 32) + number, f"{task}-{number}-{zlib.crc32(cells)}", cells.shape[1]
            here = plan.here(cells)
            lines = [(-1, place, -1 - p, -1, np.packbits(h).tobytes(), None) for p, h in enumerate(here)]
            for c, x in enumerate(cells):
                own = _held(x)
                if c not in cuts:
                    lines.append((-1, place, c, -1, x[own].astype("int32").tobytes(), None))
                    continue
                x = x[own]
                piece = _pieces(x, cuts[c])
                lines.append((-1, place, c, -1, piece.tobytes(), None))
                order = np.argsort(piece, kind="stable")
                piece, x = piece[order], x[order]
                marks = [here[p][own][order] for p in plan.asks[c] if p >= 0]
                starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, int)
                for a, b in zip(starts, [*starts[1:], len(piece)]):
                    if piece[a] % 2 == 0:
                        lines.append((c, int(piece[a]), c, int(piece[a]), x[a:b].tobytes(), b"".join(np.packbits(m[a:b]).tobytes() for m in marks)))
            slot, part, column, piece, data, marks = zip(*lines)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slot, pa.int32()),
                    pa.array(part, pa.int64()),
                    pa.array([block] * len(lines), pa.string()),
                    pa.array([size] * len(lines), pa.int32()),
                    pa.array(column, pa.int32()),
                    pa.array(piece, pa.int32()),
                    pa.array(data, pa.binary()),
                    pa.array(marks, pa.binary()),
                ],
                names=["slot", "part", "block", "size", "column", "piece", "cells", "marks"],
            )

    return df.mapInArrow(run, _PACKED)


def _ranked(packed: DataFrame, tasks: int, plan: Layout) -> DataFrame:
    """The lines with twice the ranks of cells within their piece, partner by partner, instead of the cells."""

    def run(table):
        if table["slot"][0].as_py() < 0:
            return table.drop_columns(["slot", "part", "marks"])
        partners = plan.asks[table["column"][0].as_py()]
        others = [p for p in partners if p >= 0]
        parts = [np.frombuffer(x, "float64") for x in table["cells"].to_pylist()]
        sizes = np.array([len(x) for x in parts])
        marks: list[list[np.ndarray]] = [[] for _ in others]
        for x, bits in zip(parts, table["marks"].to_pylist()):
            width = -(-len(x) // 8)
            for i in range(len(others)):
                marks[i].append(np.unpackbits(np.frombuffer(bits, "uint8", width, i * width), count=len(x)).view(bool))
        x = np.concatenate(parts)
        order = np.argsort(x)
        x = x[order]
        new = np.r_[True, x[1:] != x[:-1]]
        starts = np.flatnonzero(new)
        value = np.empty(len(x), "int64")
        value[order] = np.cumsum(new) - 1
        ends = np.cumsum(sizes)
        found: list[list[bytes]] = [[] for _ in sizes]
        for p in partners:
            if p < 0:
                counts, rows, stops = np.diff(np.r_[starts, len(x)]), value, ends
            else:
                mark = np.concatenate(marks[others.index(p)])
                counts = np.add.reduceat(mark[order].astype("int64"), starts)
                rows, stops = value[mark], np.cumsum(mark)[ends - 1]
            twice = (2 * np.cumsum(counts) - counts + 1).astype("uint32")
            ranks = twice[rows]
            for i, (a, b) in enumerate(zip(np.r_[0, stops[:-1]], stops)):
                found[i].append(ranks[a:b].tobytes())
        ranks = pa.array([b"".join(r) for r in found], pa.binary())
        return pa.table({"block": table["block"], "size": table["size"], "column": table["column"], "piece": table["piece"], "cells": ranks})

    # as many tasks as the pieces need, whatever the number set for small tables
    dealt = packed.repartition(tasks, "slot", "part")
    return dealt.groupBy("slot", "part").applyInArrow(run, "block string, size int, column int, piece int, cells binary")


def rank_products(df: DataFrame, ids: Sequence[str], pattern: Sequence[int], pairs: Sequence[tuple[int, int]], few: Sequence[int], rows: int) -> DataFrame:
    """``(i, j, n, ab, aa, bb)``: of every pair, its complete rows and the sums of products of their ranks.

    ``ids`` are columns of doubles, missing where null; those that miss the same rows have the same ``pattern``, -1 where
    none is missing. ``few`` are the columns whose values may be sent to every task.
    """
    plan = layout(pattern, pairs)
    counted = value_counts(df, ids, few, plan)
    many = [c for c in range(len(ids)) if c not in counted]
    parts = parts_for(df, rows * plan.width)
    names = [ids[c] for c in many]
    bounds = cell_bounds(df, names, parts, rows) if many and parts > 1 else {}
    cuts = {c: np.array(bounds.get(ids[c], []), "float64") for c in many}
    offsets = {c: ranks for c, (_, ranks) in counted.items()} | (piece_counts(df, ids, cuts, plan) if many else {})
    coded = with_codes(df, ids, counted)

    if not many:

        def direct(batches):
            for cells in _blocks(batches, len(ids)):
                here = plan.here(cells)
                yield _sums([x[_held(x)].astype("int32") for x in cells], here, {}, offsets, plan)

        return _added(coded.mapInArrow(direct, _SUMS))

    def gather(table):
        size = table["size"][0].as_py()
        places: list = [None] * len(ids)
        here: list = [None] * plan.patterns
        ranks: dict[int, list[tuple[int, bytes]]] = {}
        for c, piece, cells in zip(*(table[x].to_pylist() for x in ("column", "piece", "cells"))):
            if c < 0:
                here[-1 - c] = np.unpackbits(np.frombuffer(cells, "uint8"), count=size).view(bool)
            elif piece < 0:
                places[c] = np.frombuffer(cells, "uint16" if c in cuts else "int32")
            else:
                ranks.setdefault(c, []).append((piece, cells))
        if any(x is None for x in [*places, *here]):
            raise RuntimeError(UNSTABLE)
        local = {}
        for c in cuts:
            place = places[c]
            own = here[pattern[c]] if pattern[c] >= 0 else slice(None)
            sizes = [np.bincount(place if p < 0 else place[here[p][own]], minlength=2 * len(cuts[c]) + 1) for p in plan.asks[c]]
            found: list[list[np.ndarray]] = [[np.zeros(0, "uint32")] for _ in plan.asks[c]]
            for piece, cells in sorted(ranks.get(c, [])):
                ends = np.cumsum([n[piece] for n in sizes])
                for i, part in enumerate(np.split(np.frombuffer(cells, "uint32"), ends[:-1])):
                    found[i].append(part)
            for p, x in zip(plan.asks[c], found):
                local[c, p] = np.concatenate(x)
        return pa.Table.from_batches([_sums(places, here, local, offsets, plan)])

    pieces = len(many) * parts
    tasks = min(pieces, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces // TASK_PIECES))
    return _added(_ranked(_pack(coded, cuts, plan), tasks, plan).repartition(tasks, "block").groupBy("block").applyInArrow(gather, _SUMS))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "ab", "aa", "bb")])
